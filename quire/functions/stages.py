"""Cutting lineage between the stages of a job, where every executor can read it again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions.tables import salted_join

#: Rows and bytes of a small side up to which it is broadcast; measured before, never assumed.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20

_WRITTEN: dict[str, list[str]] = {}


def configured_folder(spark: SparkSession) -> str | None:
    """The folder that all executors share, as the cluster names it."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where none is set and all runs on this machine, as in tests."""
    sc = spark.sparkContext
    if (folder := sc.getCheckpointDir()) is not None:
        return folder
    folder = configured_folder(spark)
    if folder is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quire-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the shared folder from then on."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a table in the shared folder until the session ends: for rows that are read several times.

    A table takes a fraction of a checkpoint's room, since equal keys are stored once.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return spark.read.schema(df.schema).parquet(folder)


def drop_written(spark: SparkSession) -> None:
    """Delete the tables that ``written`` made for this session."""
    for folder in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _at_the_end() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _WRITTEN:
        try:
            drop_written(spark)
        except Exception:  # noqa: BLE001, S110 - the session is gone, and its folder with it
            pass


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` (which should be cheap to read) has so few rows and bytes, told from its rows; strings and arrays are measured."""
    width = F.lit(0)
    for name, kind in df.dtypes:
        text = F.col(f"`{name}`") if kind in ("string", "binary") else F.to_json(F.struct(f"`{name}`")) if kind.startswith(("array", "map", "struct")) else None
        width = width + (F.lit(8) if text is None else F.coalesce(F.octet_length(text), F.lit(0)) + 16)
    n, total = df.limit(rows + 1).agg(F.count("*"), F.sum(width)).first()
    return n <= rows and (total or 0) <= size


def checked_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Equi-join with a small side of unknown size: computed and measured first, then broadcast, or salted beyond ``most`` rows or ``BROADCAST_BYTES``."""
    small = cut(small)
    if is_small(small, most):
        return big.join(F.broadcast(small), keys, how)
    return salted_join(big, small, keys, how=how)


def is_in(column: Column, values: list[str]) -> Column:
    return column.isin(*values) if values else F.lit(False)
