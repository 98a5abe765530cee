"""Problem 5: recomputing only the partitions whose records changed.

Records that tend to change together stay together: a key goes to the bucket of its first column
(the user), and a value that holds more than a bucket's share of all rows is split by the whole
key. Each partition of each input has a fingerprint: its number of rows and the sums of its rows'
hashes, which do not depend on the order of rows and add up over tasks, so they are one aggregate
with map-side combine. A run compares them with the fingerprints of the last successful run,
recomputes the partitions that differ and replaces those, each as a whole, through dynamic
partition overwrite. The fingerprints are evaluated once, before the rows are read, and written
last: a run that fails before is repeated with the same result, one that fails between leaves
nothing that the next run does not overwrite, and a change that comes in while a run works is found
by the next one. A key whose partition changes, because its user became large, changes the
fingerprints of both.

A row's hash reads every field with a bit that says whether it is null, fields of structs
included, so a value that moves to a neighbouring field is a change. Null keys have a partition of
their own hash. Empty inputs give partitions without rows. Extra columns count like all others.
"""

from __future__ import annotations

import hashlib
import inspect
import sys
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from quire.functions.stages import configured_folder, cut, shared_folder
from quire.functions.tables import latest_rows

#: Buckets at least, rows of the first input in one, and pieces into which a large value may be split.
PARTITIONS, ROWS, SPLITS = 64, 50_000, 64
Inputs = dict[str, DataFrame]


def leaves(column: Column, kind: DataType) -> Iterator[Column]:
    """What a hash of ``column`` must read so that different values look different."""
    yield column.isNull()
    if isinstance(kind, StructType):
        for field in kind.fields:
            yield from leaves(column[field.name], field.dataType)
    else:
        yield column
        if isinstance(kind, (ArrayType, MapType)):  # a hash skips the nulls inside, their text does not
            yield F.to_json(column)


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of a row in which nulls count."""
    return F.xxhash64(*[c for f in df.schema.fields for c in leaves(F.col(f"`{f.name}`"), f.dataType)])


def _sums(df: DataFrame) -> list[Column]:
    # 32-bit halves: their sums cannot overflow below 2^31 rows a partition
    h = row_hash(df)
    return [F.count("*").alias("n"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).alias("high")]


class Layout:
    """Which partition a key belongs to: ``n`` buckets of the first key column, each of ``SPLITS`` pieces.

    Only values with more than a bucket's share of the rows use more than one piece, so there are at most ``n`` of them.
    """

    def __init__(self, df: DataFrame, keys: list[str], n: int):
        self.keys, self.n = keys, n
        counts = df.groupBy(keys[0]).agg(F.count("*").alias("rows"))
        total = df.count()
        large = counts.where((F.col("rows") * n > total) & F.col(keys[0]).isNotNull()).collect() if total else []
        self.pieces = {r[keys[0]]: min(SPLITS, 1 << (-(-r["rows"] * n // total) - 1).bit_length()) for r in large}

    def part(self) -> Column:
        pieces = F.lit(1)
        if self.pieces:
            table = F.create_map(*[F.lit(x) for pair in sorted(self.pieces.items()) for x in pair])
            pieces = F.coalesce(F.element_at(table, F.col(self.keys[0])), F.lit(1))
        bucket = F.pmod(F.xxhash64(self.keys[0]), F.lit(self.n))
        return (bucket * SPLITS + F.pmod(F.xxhash64(*self.keys), pieces)).cast("int")


def fingerprints(inputs: Inputs, shared: Inputs, layout: Layout, rules: str) -> DataFrame:
    """(part, mark) of every partition with a row in any input; ``shared`` inputs count in every partition."""
    common = [rules]
    for df in shared.values():
        row = df.agg(*_sums(df)).first()
        common.append(f"{row['n']}:{row['low']}:{row['high']}")
    base = None
    for k, df in enumerate(inputs.values()):
        own = df.withColumn("part", layout.part()).groupBy("part").agg(*_sums(df)).select("part", F.concat_ws(":", "n", "low", "high").alias(f"m{k}"))
        base = own if base is None else base.join(own, "part", "full")
    return base.select("part", F.concat_ws("|", F.lit("|".join(common)), *[F.coalesce(f"m{k}", F.lit("0")) for k in range(len(inputs))]).alias("mark"))


def rules_of(compute: Callable) -> str:
    """A digest of the source of ``compute``'s module and of the modules of this package that it takes names from."""
    own = inspect.getmodule(compute)
    package = __name__.split(".")[0]
    names = {own.__name__} | {m for x in vars(own).values() if (m := getattr(x, "__module__", None) or "").startswith(package)}
    text = "".join(inspect.getsource(sys.modules[m]) for m in sorted(names) if m in sys.modules)
    return hashlib.sha256(text.encode()).hexdigest()[:12]


class ChangedPartitions:
    """A result kept up to date under ``folder`` by partitions of ``keys``; at least ``partitions`` buckets, more for more rows."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], partitions: int = PARTITIONS):
        self.spark, self.folder, self.keys, self.n = spark, folder.rstrip("/"), keys, partitions

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(path) and any(s.getPath().getName().startswith("part=") for s in fs.listStatus(path))

    def _replace(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.folder}/{name}")

    def _buckets(self, rows: int) -> int:
        """A power of two times ``n`` that leaves at most ``ROWS`` rows to a bucket in the mean."""
        return self.n << max(0, (-(-rows // (self.n * ROWS)) - 1).bit_length())

    def changed(self, now: DataFrame) -> DataFrame:
        """(part, mark) of the partitions whose fingerprint is not the stored one; a part that is no longer there has the mark null."""
        if not self._exists("fingerprints"):
            return now
        old = self.spark.read.parquet(f"{self.folder}/fingerprints").select("part", F.col("mark").alias("old"))
        both = now.join(old.where("old is not null"), "part", "full")
        return both.where(~F.col("old").eqNullSafe(F.col("mark"))).select("part", "mark")

    def refresh(self, compute: Callable[[Inputs], DataFrame], inputs: Inputs, shared: Inputs | None = None) -> list[int]:
        """Recompute what changed; returns the partitions that were replaced.

        ``compute`` gets the inputs (with those of ``shared`` whole) and must return rows with the key
        columns, depending for each key only on that key's rows and the shared ones. Its rules are part
        of every fingerprint, so changed rules recompute all.
        """
        first = next(iter(inputs.values()))
        layout = Layout(first, self.keys, self._buckets(first.count()))
        now = cut(fingerprints(inputs, shared or {}, layout, rules_of(compute)))
        due = cut(self.changed(now))
        parts = sorted(r["part"] for r in due.select("part").collect())  # at most buckets times SPLITS numbers
        if not parts:
            return parts
        wanted = layout.part().isin(parts)
        result = compute({k: df.where(wanted) for k, df in inputs.items()} | (shared or {}))
        rows = result.withColumn("part", layout.part()).withColumn("is_row", F.lit(True))
        # an empty partition is replaced too: by a row that only marks it; tasks follow the size of what is written
        marks = due.select("part").withColumn("is_row", F.lit(False))
        self._replace(rows.unionByName(marks, allowMissingColumns=True).repartition("part"), "rows")
        self._replace(due.repartition("part"), "fingerprints")
        return parts

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows").where("is_row").drop("is_row", "part")


def documents_to_chunk(inputs: Inputs) -> DataFrame:
    """(user_id, doc_id): documents of the manifest with a finished extract row that are not up to date, each once.

    A row is finished when output and completed_at are set; the latest counts, ties go to the
    greater version. Rows with a null key belong to no document.
    """
    keys = ["user_id", "doc_id"]
    documents = inputs["manifest"].select(*keys).where("user_id is not null and doc_id is not null").distinct()
    finished = inputs["stages"].where("output is not null and completed_at is not null and stage in ('extract', 'chunk')")
    last = latest_rows(finished.select(*keys, "stage", "completed_at", "version"), [*keys, "stage"], ["completed_at"])
    extract = last.where("stage = 'extract'").select(*keys, F.col("completed_at").alias("extracted_at"), F.col("version").alias("extractor"))
    chunk = last.where("stage = 'chunk'").select(*keys, F.col("completed_at").alias("chunked_at"), F.col("version").alias("chunker"))
    rule = inputs["current_versions"].where("stage = 'chunk'").agg(F.max("version").alias("v")).first()["v"]
    written = inputs["chunked"].select(*keys, "chunker").where("chunker is not null").distinct().withColumn("written", F.lit(True))
    joined = documents.join(extract, keys).join(chunk, keys, "left").join(written, [*keys, "chunker"], "left")
    fresh = (F.col("chunked_at") >= F.col("extracted_at")) & (F.col("chunker") == F.concat(F.lit(rule), F.lit(":"), F.col("extractor"))) & F.col("written")
    return joined.where(~F.coalesce(fresh, F.lit(False))).select(*keys)


def state_folder(spark: SparkSession, name: str, of: str) -> str:
    """Where a result over the tables ``of`` is kept: under the cluster's shared folder, so that later runs find it."""
    base = configured_folder(spark) or shared_folder(spark)
    return f"{base}/{name}-{hashlib.sha256(of.encode()).hexdigest()[:16]}"
