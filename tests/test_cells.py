import numpy as np
from pyspark.sql import functions as F

from quire.operators import cells, vectors


def clustered(spark, n=4000, width=16, hot=True):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(30, width))
    pick = np.where((np.arange(n) % 3 == 0) & hot, 0, rng.integers(0, 30, n))  # a third of all rows lie in one place
    x = middle[pick] + 0.35 * rng.normal(size=(n, width))
    rows = [(int(i), [float(v) for v in x[i]] if i % 97 else None) for i in range(n)] + [(n, [0.0] * width)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(6)


def test_recall_against_brute_force(spark):
    rows = clustered(spark)
    asked, (centres, probes) = rows.where("vec_id % 50 = 0"), cells.fit(rows, k=10)
    indexed = cells.assigned(rows, centres).cache()
    assert indexed.count() == rows.where("embedding is not null and vec_id < 4000").count() and probes < len(centres) == 99
    exact = vectors.search_all(rows, asked, k=10).cache()
    found = cells.search(indexed, asked, centres, probes, k=10).cache()
    measured = cells.recall(found, exact).first()
    assert measured["recall"] >= 0.9 and measured["n_exact"] == exact.count()
    # all cells: the exact answer
    every = cells.search(indexed, asked, centres, len(centres), k=10)
    assert sorted((r["query_id"], r["vec_id"], r["rank"], round(r["score"], 9)) for r in every.collect()) == sorted((r["query_id"], r["vec_id"], r["rank"], round(r["score"], 9)) for r in exact.collect())


def test_string_keys_empty_tables_and_more_neighbours_than_rows(spark):
    rows = clustered(spark, 60, hot=False).withColumn("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string"))).withColumn("cell", F.lit("x"))
    centres, _ = cells.fit(rows)
    found = cells.search(cells.assigned(rows, centres), rows.where("vec_id = 'v7'"), centres, 9, k=100)
    assert found.count() == 59 and found.orderBy("rank").first()["vec_id"] == "v7"
    empty = rows.limit(0)
    none, probes = cells.fit(empty)
    assert cells.assigned(empty, none).count() == 0 and cells.search(cells.assigned(empty, none), rows, none, probes).count() == 0
    assert cells.search(cells.assigned(rows, centres), empty, centres, 3).count() == 0
