"""Scanned files against the manifest: new, unchanged, moved, duplicate, missing or in error.

Files are compared in path-component order, so that the same copy is kept whatever the scan's order.
A file whose content is registered under another source is a duplicate while the recorded file
still exists there, and a move once it is gone. A changed label alone counts as moved. Files in
error are not seen: their old record is missing. Null contents (unreadable files) are errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

KEY = ["user_id", "doc_id"]


def path_order(path: Column) -> Column:
    """Paths by their components: a/b before a-b/c."""
    return F.split(path, "/")


def keep_first(files: DataFrame) -> DataFrame:
    """``files`` with ``copy`` (1: the kept one) and ``kept_path``, for each user, source and content."""
    w = W.partitionBy("user_id", "source", "doc_id").orderBy(path_order(F.col("rel_path")))
    return files.withColumn("copy", F.row_number().over(w)).withColumn("kept_path", F.first("rel_path").over(w))


def register(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(user_id, source, doc_id, rel_path, status, detail) of every file and of every missing record.

    ``files`` has user_id, source, rel_path, doc_id, metadata and error (null: none); ``manifest`` one row
    for each (user_id, doc_id).
    """
    bad = files.where("error is not null or doc_id is null")
    good = keep_first(files.where("error is null and doc_id is not null"))
    first = good.where("copy = 1")
    old = manifest.select(*KEY, F.col("source").alias("old_source"), F.col("rel_path").alias("old_path"), F.col("metadata").alias("old_metadata"))
    there = good.select("user_id", F.col("source").alias("old_source"), F.col("rel_path").alias("old_path"), F.lit(True).alias("still_there")).distinct()
    joined = first.join(old, KEY, "left").join(there, ["user_id", "old_source", "old_path"], "left")
    same = (F.col("old_path") == F.col("rel_path")) & (F.col("old_source") == F.col("source")) & F.col("old_metadata").eqNullSafe(F.col("metadata"))
    elsewhere = (F.col("old_source") != F.col("source")) & F.coalesce("still_there", F.lit(False))
    status = F.when(F.col("old_path").isNull(), "new").when(elsewhere, "duplicate").when(same, "unchanged").otherwise("moved")
    detail = F.when(status == "duplicate", F.concat_ws("/", "old_source", "old_path")).when(status == "moved", F.col("old_path"))
    columns = ["user_id", "source", "doc_id", "rel_path"]
    judged = joined.select(*columns, status.alias("status"), detail.alias("detail"))
    copies = good.where("copy > 1").select(*columns, F.lit("duplicate").alias("status"), F.col("kept_path").alias("detail"))
    errors = bad.select(*columns, F.lit("error").alias("status"), F.coalesce("error", F.lit("unreadable")).alias("detail"))
    seen = first.select("user_id", "source", "doc_id").distinct()
    missing = manifest.join(seen, ["user_id", "source", "doc_id"], "left_anti").select(*columns, F.lit("missing").alias("status"), F.lit(None).cast("string").alias("detail"))
    return judged.unionByName(copies).unionByName(errors).unionByName(missing)


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("source", "status").agg(F.count("*").alias("n"))


def apply_statuses(manifest: DataFrame, files: DataFrame, statuses: DataFrame, now: Column) -> DataFrame:
    """The manifest after a run: new records added, moved ones relocated with their id, the rest kept."""
    kept = files.select("user_id", "source", "rel_path", "doc_id", "size_bytes", "metadata")
    changed = statuses.where("status in ('new', 'moved')").select("user_id", "source", "doc_id", "rel_path", "status")
    rows = changed.join(kept, ["user_id", "source", "doc_id", "rel_path"]).dropDuplicates(KEY)
    first = manifest.select(*KEY, F.col("registered_at").alias("first_at"))
    added = rows.join(first, KEY, "left").select(*KEY, "source", "rel_path", "size_bytes", "metadata", F.coalesce("first_at", now).alias("registered_at"), now.alias("updated_at"))
    return manifest.join(rows.select(*KEY), KEY, "left_anti").unionByName(added)
