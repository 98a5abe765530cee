"""Files of a source folder as a table, read by Spark's binary reader."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def case_glob(extensions: Iterable[str]) -> str:
    """A glob that takes the extensions in either case."""
    one = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e.lstrip("."))
    return "*.{" + ",".join(sorted({one(e) for e in extensions})) + "}"


def is_hidden(rel_path: Column) -> Column:
    """Any part of the path that begins with a dot or with the sign of a lock file."""
    return F.exists(F.split(rel_path, "/"), lambda p: p.startswith(".") | p.startswith("~$"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan(spark: SparkSession, root: str, extensions: Iterable[str], content: bool = True) -> DataFrame:
    """(path, rel_path, size_bytes, modified_at[, content]) of the visible files under ``root``; none where it is missing.

    The reader itself leaves out names that begin with an underscore. Rows are in no order.
    """
    columns = "path string, rel_path string, size_bytes bigint, modified_at timestamp" + ", content binary" * content
    if not exists(spark, root):
        return spark.createDataFrame([], columns)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", case_glob(extensions)).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = unquote(base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()).rstrip("/") + "/"
    rel = F.expr(f"substring(path, {len(full) + 1})")
    rows = files.select("path", rel.alias("rel_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), *["content"] * content)
    return rows.where(~is_hidden(F.col("rel_path")))


def identified(files: DataFrame, user_id: str, source: str) -> DataFrame:
    """(user_id, source, rel_path, path, size_bytes, doc_id): files named by the SHA-256 of their bytes."""
    return files.select(F.lit(user_id).alias("user_id"), F.lit(source).alias("source"), "rel_path", "path", "size_bytes", F.sha2("content", 256).alias("doc_id"))
