"""Tables kept as whole snapshots: a run writes the next one and then moves the pointer.

Readers see the old snapshot until the pointer names the new one, so no reader meets a gap, and a
run that fails leaves the pointer where it was. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class SnapshotTable:
    def __init__(self, spark: SparkSession, folder: str, schema: str, partition_by: tuple[str, ...] = ()):
        self.spark, self.folder, self.schema, self.partition_by = spark, folder.rstrip("/"), schema, partition_by

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The number of the current snapshot; 0 where there is none."""
        fs, folder = self._fs(self.folder)
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max([int(n[8:]) for n in names if n.startswith("current=")], default=0)

    def read(self) -> DataFrame:
        n = self.version()
        if not n:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v={n}")

    def replace(self, df: DataFrame) -> int:
        """Write the next snapshot, point at it, and remove all but the one before."""
        n = self.version() + 1
        names = self.spark.createDataFrame([], self.schema).columns
        writer = df.select(*names).write.mode("overwrite")
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(f"{self.folder}/v={n}")
        fs, marker = self._fs(f"{self.folder}/current={n}")
        fs.create(marker, True).close()
        for k in range(1, n):
            for old in [f"{self.folder}/current={k}", *[f"{self.folder}/v={k}"] * (k < n - 1)]:
                ofs, path = self._fs(old)
                ofs.delete(path, True)
        return n
