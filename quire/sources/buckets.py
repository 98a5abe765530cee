"""Tables kept in buckets of documents: a run rewrites only the buckets of the documents it touched.

A row lies in the bucket of its document's hash. Each bucket has a version, the run that wrote it last;
the map from buckets to versions is one small file, written after the rows, and readers go by it. So a
reader sees the table before a run or after it, and a run that fails leaves the map as it was. One writer
at a time. Null keys have a bucket of their own hash. The number of buckets is fixed when a
table is first written; a changed document costs about one part in so many of the table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEY = ("user_id", "doc_id")
BUCKETS = 256


class BucketTable:
    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: Sequence[str] = KEY, buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.keys, self._n = spark, folder.rstrip("/"), schema, list(keys), buckets
        self.columns = spark.createDataFrame([], schema).columns

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def state(self) -> dict:
        """{run, buckets, map}: the map names the run that wrote each bucket; at most as many entries as buckets."""
        fs, folder = self._fs(self.folder)
        runs = [int(s.getPath().getName()[8:]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("current=")] if fs.exists(folder) else []
        if not runs:
            return {"run": 0, "buckets": self._n, "map": {}}
        text = self.spark.read.text(f"{self.folder}/current={max(runs)}", wholetext=True).first()[0]
        return json.loads(text)

    def _paths(self, state: dict, buckets: Sequence[int] | None = None) -> list[str]:
        chosen = state["map"] if buckets is None else {str(b): state["map"][str(b)] for b in buckets if str(b) in state["map"]}
        return [f"{self.folder}/v={run}/bucket={b}" for b, run in sorted(chosen.items())]

    def _load(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._load(self._paths(self.state()))

    def bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def replace_documents(self, new: DataFrame, touched: DataFrame) -> list[int]:
        """The touched documents' rows become ``new``; returns the buckets that were written. Documents with no new row lose theirs."""
        state = self.state()
        n, run = state["buckets"], state["run"] + 1
        place = self.bucket(n)
        named = touched.select(*self.keys).unionByName(new.select(*self.keys)).distinct()
        buckets = sorted(r[0] for r in named.select(place.alias("b")).distinct().collect())  # at most n numbers
        if not buckets:
            return buckets
        old = self._load(self._paths(state, buckets))
        same = [F.col(f"_t.{k}").eqNullSafe(F.col(f"_o.{k}")) for k in self.keys]
        kept = old.alias("_o").join(named.alias("_t"), same, "left_anti").select(*self.columns)
        rows = kept.unionByName(new.select(*self.columns)).withColumn("bucket", place)
        rows.repartition("bucket").sortWithinPartitions("bucket", *self.keys).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/v={run}")
        fs, written = self._fs(f"{self.folder}/v={run}")
        there = {int(s.getPath().getName()[7:]) for s in fs.listStatus(written) if s.getPath().getName().startswith("bucket=")}
        before = state["map"]
        after = {b: v for b, v in before.items() if int(b) not in buckets} | {str(b): run for b in buckets if b in there}
        self._point(run, {"run": run, "buckets": n, "map": after}, before)
        return buckets

    def replace(self, df: DataFrame) -> list[int]:
        """All rows anew."""
        return self.replace_documents(df, self.read().select(*self.keys))

    def _point(self, run: int, state: dict, before: dict) -> None:
        """Write the new map under another name and move it into place; drop what neither it nor the one before names."""
        fs, marker = self._fs(f"{self.folder}/current={run}")
        _, draft = self._fs(f"{self.folder}/_draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(draft, marker):
            raise OSError(f"cannot write {marker}")
        alive = {(b, v) for kept in (state["map"], before) for b, v in kept.items()}
        for status in fs.listStatus(self._fs(self.folder)[1]):
            name = status.getPath().getName()
            if name.startswith("current=") and int(name[8:]) < run - 1:
                fs.delete(status.getPath(), True)
            elif name.startswith("v="):
                version, inner = int(name[2:]), list(fs.listStatus(status.getPath()))
                dead = [s for s in inner if s.getPath().getName().startswith("bucket=") and (s.getPath().getName()[7:], version) not in alive]
                for s in dead:
                    fs.delete(s.getPath(), True)
                if len(dead) == sum(s.getPath().getName().startswith("bucket=") for s in inner) and version < run:
                    fs.delete(status.getPath(), True)
