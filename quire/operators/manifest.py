"""The manifest of documents and the log of finished stages, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions.tables import all_of, latest_rows

KEY = ["user_id", "doc_id"]
#: Fixed value: how documents without a label are counted.
UNORGANISED = "(unorganised)"


def current(manifest: DataFrame) -> DataFrame:
    """One row for each document: the latest by updated_at (ties by all columns). Rows with a null key are dropped."""
    rows = manifest.where("user_id is not null and doc_id is not null")
    return latest_rows(rows, KEY, ["updated_at", "rel_path"]).select(*manifest.columns)


def get(manifest: DataFrame, user_id: str, doc_id: str) -> DataFrame:
    return manifest.where((F.col("user_id") == user_id) & (F.col("doc_id") == doc_id))


def documents(manifest: DataFrame, user_id: str, source: str | None = None) -> DataFrame:
    rows = manifest.where(F.col("user_id") == user_id)
    return (rows if source is None else rows.where(F.col("source") == source)).orderBy("source", "rel_path")


def listed(manifest: DataFrame) -> DataFrame:
    """Every user's documents in the order in which they are listed: ``place`` from 1, by source, path and id."""
    return manifest.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy("source", "rel_path", "doc_id")))


def matches(query: str) -> Column:
    """Document id prefix or part of the path, letters of either case, wildcards taken literally."""
    wanted = F.lower(F.lit(query))
    return F.startswith(F.lower("doc_id"), wanted) | F.contains(F.lower("rel_path"), wanted)


def find(manifest: DataFrame, user_id: str, query: str) -> DataFrame:
    return manifest.where((F.col("user_id") == user_id) & matches(query)).orderBy("source", "rel_path")


def add(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert; raises where a key is there already or comes twice."""
    twice = rows.groupBy(*KEY).count().where("count > 1").select(*KEY).unionByName(rows.join(manifest, KEY, "left_semi").select(*KEY)).limit(1).collect()
    if twice:
        raise ValueError(f"document already registered: {tuple(twice[0])}")
    return manifest.unionByName(rows)


def update_location(manifest: DataFrame, moved: DataFrame, now: Column) -> DataFrame:
    """Relocate documents (user_id, doc_id, source, rel_path, metadata); ids, sizes and stages stay."""
    new = moved.select(*KEY, *[F.col(c).alias(f"_{c}") for c in ("source", "rel_path", "metadata")], F.lit(True).alias("_moved"))
    joined = manifest.join(new, KEY, "left")
    pick = lambda c: F.when(F.col("_moved"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*[pick(c) if c in ("source", "rel_path", "metadata") else F.when(F.col("_moved"), now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in manifest.columns])


def mark_done(stages: DataFrame, done: DataFrame) -> DataFrame:
    """Upsert of stage rows: the new row of a (document, stage) replaces the old."""
    keys = [*KEY, "stage"]
    return stages.join(done.select(*keys), keys, "left_anti").unionByName(done)


def current_stages(stages: DataFrame) -> DataFrame:
    """The log reduced to one finished row for each (document, stage): the latest; ties go to the greater version."""
    finished = stages.where("output is not null and completed_at is not null and user_id is not null and doc_id is not null and stage is not null")
    return latest_rows(finished, [*KEY, "stage"], ["completed_at", "version"]).select(*stages.columns)


def stage(stages: DataFrame, user_id: str, doc_id: str, name: str) -> DataFrame:
    return stages.where(all_of([F.col("user_id") == user_id, F.col("doc_id") == doc_id, F.col("stage") == name]))


def prune(manifest: DataFrame, missing: DataFrame) -> DataFrame:
    """The manifest without the named documents; a deliberate action of its own."""
    return manifest.join(missing.select(*KEY).distinct(), KEY, "left_anti")


def stage_gate(documents: DataFrame, stages: DataFrame, stage_name: str, version: Column, outputs: DataFrame | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """(user_id, doc_id[, columns], status): 'up_to_date' or 'to_do' for every document.

    Up to date: the stage's row has the ``version`` now in force (a column over the documents) and, where
    ``outputs`` (user_id, doc_id) is given, its output is still there. A lost output is made again.
    """
    done = stages.where(F.col("stage") == stage_name).select(*KEY, F.col("version").alias("done_version"))
    joined = documents.withColumn("_wanted", version).join(done, KEY, "left")
    fresh = F.coalesce(F.col("done_version") == F.col("_wanted"), F.lit(False))
    if outputs is not None:
        joined = joined.join(outputs.select(*KEY).distinct().withColumn("_there", F.lit(True)), KEY, "left")
        fresh = fresh & F.coalesce("_there", F.lit(False))
    return joined.select(*KEY, *columns, F.when(fresh, "up_to_date").otherwise("to_do").alias("status"))


def stage_totals(stages: DataFrame) -> DataFrame:
    """(stage, version, n): how many documents each version of each stage has done."""
    return stages.groupBy("stage", "version").agg(F.count("*").alias("n"))


def subject_counts(manifest: DataFrame) -> DataFrame:
    """(source, subject, doc_type, n): documents by label, '(unorganised)' where there is none, with totals as nulls."""
    label = lambda c: F.coalesce(F.col(f"metadata.{c}"), F.lit(UNORGANISED))
    rows = manifest.select("source", label("subject").alias("subject"), label("doc_type").alias("doc_type"))
    return rows.rollup("source", "subject", "doc_type").agg(F.count("*").alias("n"))
