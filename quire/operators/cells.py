"""Approximate search: vectors in cells around centres, of which a question looks into the nearest.

The centres are fitted on a bounded sample (``SAMPLE`` rows in the order of a hash of the key); every
row is then put into the cell of its nearest centre. A question is compared with the rows of its
``probes`` nearest cells alone. Questions are broadcast by blocks and each task keeps the best rows of
its own, so rows are not moved and a cell that holds a third of all rows costs no task more than
its share. Written by cell, a table is read only where a question looks.

How many cells a question looks into is fitted too: as many as hold ``TARGET`` of the true neighbours of
questions from the sample, counted on the sample. Vectors without structure need many cells, clustered ones few.

Null and zero vectors are in no cell. Ties are by key. Recall is measured against ``vectors.search_all``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from quire.operators.vectors import QUERY_BYTES, SCORES, best_of, key_values, numbers, unit_rows

#: Rows that the centres are fitted on, rows of the sample for each centre, centres at most, and rounds of fitting.
SAMPLE, ROWS_A_CENTRE, MOST_CENTRES, ROUNDS = 20_000, 40, 1024, 12
#: Questions of the sample, and the share of their neighbours that must lie in the cells they look into.
QUESTIONS, TARGET = 500, 0.96


def sampled(vectors: DataFrame, key: str, vector: str, sample: int) -> np.ndarray:
    rows = vectors.where(F.col(vector).isNotNull()).select(key, vector).orderBy(F.xxhash64(key), key).limit(sample).toArrow().combine_chunks()
    return unit_rows(numbers(rows.column(vector).combine_chunks())[0])[0] if rows.num_rows else np.zeros((0, 1))


def centres_of(x: np.ndarray) -> np.ndarray:
    """Unit vectors in the middle of cells: spherical k-means from points that lie far apart."""
    n = min(MOST_CENTRES, -(-len(x) // ROWS_A_CENTRE))
    if not n:
        return np.zeros((0, 1))
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < n:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(ROUNDS):
        total = np.zeros_like(centres)
        np.add.at(total, (x @ centres.T).argmax(1), x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.maximum(size, 1e-12), centres)
    return centres


def probes_of(x: np.ndarray, centres: np.ndarray, k: int, target: float = TARGET) -> int:
    """The least number of nearest cells that hold ``target`` of the ``k`` nearest rows of the questions, among the sample."""
    asked = x[:QUESTIONS]
    if len(x) < 2:
        return 1
    scores = asked @ x.T
    near = np.argpartition(-scores, min(k, len(x) - 1), axis=1)[:, : k + 1]  # a question is its own neighbour, as in a search
    order = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")
    place = np.take_along_axis(order, (x @ centres.T).argmax(1)[near], 1).ravel()
    return int(np.quantile(place, target, method="higher")) + 1


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, sample: int = SAMPLE) -> tuple[np.ndarray, int]:
    """The centres and the number of cells to look into."""
    x = sampled(vectors, key, vector, sample)
    centres = centres_of(x)
    return centres, probes_of(x, centres, k)


def assigned(vectors: DataFrame, centres: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, vector, cell): every row with a vector, in the cell of its nearest centre."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    rows = vectors.select(key, vector)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, valid = numbers(batch.column(vector))
            x, solid = unit_rows(x)
            if len(x) and len(shared.value):
                at = pa.array(valid[solid])
                yield batch.take(at).append_column("cell", pa.array((x @ shared.value.T).argmax(1).astype(np.int32)))

    return rows.mapInArrow(work, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", cell int")


def search(indexed: DataFrame, queries: DataFrame, centres: np.ndarray, probes: int, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank): the ``k`` best rows of each query among the cells it looks into."""
    spark, kind = indexed.sparkSession, indexed.schema[key].dataType.simpleString()
    schema = f"query_id {kind}, {key} {kind}, score double"
    queries = queries.where(F.col(vector).isNotNull()).select(key, vector)
    n = -(-queries.count() * 8 * (centres.shape[1] + 2 * probes) // QUERY_BYTES) or 1
    found = spark.createDataFrame([], schema)
    for part in range(n):
        rows = (queries if n == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == part)).orderBy(key).toArrow().combine_chunks()
        if not rows.num_rows or not len(centres):
            continue
        asked, at = unit_rows(numbers(rows.column(vector).combine_chunks())[0])
        cells = np.argsort(-(asked @ centres.T), axis=1, kind="stable")[:, :probes]
        shared = spark.sparkContext.broadcast((key_values(rows.column(key).combine_chunks())[at], asked, cells))

        def work(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, asked, cells = shared.value
            looks = np.argsort(cells, axis=None, kind="stable")
            by_cell = cells.ravel()[looks]
            scores, names = np.full((len(asked), k), -np.inf), None
            for batch in batches:
                x, _ = numbers(batch.column(vector))
                x, solid = unit_rows(x)
                own, cell = key_values(batch.column(key))[solid], batch.column("cell").to_numpy()[solid]
                if names is None:
                    names = np.zeros((len(asked), k), own.dtype)
                elif own.dtype.itemsize > names.dtype.itemsize:
                    names = names.astype(own.dtype)
                order = np.argsort(cell, kind="stable")
                for rows_of in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else ():
                    low, high = np.searchsorted(by_cell, [cell[rows_of[0]], cell[rows_of[0]] + 1])
                    who = looks[low:high] // cells.shape[1]
                    step = max(1, SCORES // max(1, len(who)))
                    for first in range(0, len(rows_of) if len(who) else 0, step):
                        some = rows_of[first : first + step]
                        s = np.concatenate([scores[who], np.round(asked[who] @ x[some].T, 12)], 1)
                        i = np.concatenate([names[who], np.broadcast_to(own[some], (len(who), len(some)))], 1)
                        scores[who], names[who] = best_of(s, i, k)
            if names is not None:
                q, place = np.nonzero(np.isfinite(scores))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(names[q, place]), pa.array(scores[q, place])], ["query_id", key, "score"])

        found = found.unionByName(indexed.select(key, vector, "cell").where(F.col("cell").isin(np.unique(cells).tolist())).mapInArrow(work, schema))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """(n_exact, n_found, recall): how many of the exact (query_id, key) pairs were found."""
    hits = exact.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return hits.agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))
