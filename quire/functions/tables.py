"""Reading a test or production directory of parquet tables, and joins that survive hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join in which each key's rows of ``big`` are spread over ``salts`` tasks and ``small`` is copied to them.

    For joins whose big side may hold a third of all rows under one key. ``small`` needs one row
    for each key; it is copied ``salts`` times, so its size stays proportional to itself.
    Null keys match nothing. Spark may still broadcast ``small`` when its measured size is
    under spark.sql.autoBroadcastJoinThreshold.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)).cast("int")
    left = big.withColumn("_salt", salt)
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def latest_rows(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """One row for each key: the one with the greatest ``by`` values (nulls lowest; ties by all columns).

    A hash aggregate with map-side combine, so repeated or hot keys never meet in one sort.
    """
    rest = [c for c in df.columns if c not in keys]
    order = [*by, *[c for c in rest if c not in by]]
    best = F.max(F.struct(*[F.col(c) for c in order])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])
