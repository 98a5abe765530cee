"""Vectors: embedding, a collection kept by document, and exact filtered search."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from quire.functions.tables import all_of

#: Bytes of query vectors that one pass over the collection searches, which bounds what is broadcast, and scores that a task holds at a time.
QUERY_BYTES, SCORES = 32 << 20, 1 << 22


def hash_embedding(df: DataFrame, text: str = "text", dimension: int = 64, column: str = "embedding") -> DataFrame:
    """``df`` with a bag-of-words vector: each word counts in bucket crc32(word) mod dimension, with a trace in bucket 0.

    Null and empty texts get the trace alone, so no vector is zero. Words are runs of word characters in lower case.
    """
    # a word's bucket is computed once in a task; its places in the texts are one count over all of a batch
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            lists = pc.split_pattern_regex(pc.utf8_lower(batch.column(text).fill_null("")), pattern=r"[^\p{L}\p{N}_]+")
            words = lists.flatten().dictionary_encode()
            if len(known) > 500_000:
                known.clear()
            bucket = np.array([-1 if not w else known[w] if w in known else known.setdefault(w, zlib.crc32(w.encode()) % dimension) for w in words.dictionary.to_pylist()], np.int64)
            rows = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            at = bucket[words.indices.to_numpy(zero_copy_only=False)] if len(bucket) else np.zeros(0, np.int64)
            vectors = np.bincount((rows * dimension + at)[at >= 0], minlength=batch.num_rows * dimension).astype(np.float64)
            vectors[::dimension] += 1e-6
            ends = pa.array(np.arange(batch.num_rows + 1) * dimension, pa.int32())
            yield batch.append_column(column, pa.ListArray.from_arrays(ends, pa.array(vectors, pa.float32())))

    return df.mapInArrow(work, StructType([*df.schema.fields, StructField(column, ArrayType(FloatType()))]))


def word_buckets(df: DataFrame, key: str, text: str = "text", dimension: int = 64) -> DataFrame:
    """(key, bucket, n): words by md5 bucket, all in built-in functions; lower-case runs of letters and digits."""
    words = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    bucket = (F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("bigint") % dimension).cast("int")
    return df.select(key, words.alias("w")).groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def tenant(user_id: str, **equals: str | None) -> Column:
    """The user's rows, and equality for every value that is given."""
    return all_of([F.col("user_id") == user_id, *[F.col(k) == v for k, v in equals.items() if v is not None]])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null for a zero vector."""
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(double(a), double(b), lambda x, y: x * y))
    norm = lambda c: F.sqrt(total(F.transform(double(c), lambda x: x * x)))
    return F.try_divide(dot, norm(a) * norm(b))


def search(vectors: DataFrame, query: Sequence[float], where: Column | None = None, k: int = 5, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest by cosine among those that pass the filter; ties by key. Rows without a vector score nothing.

    The filter reaches the scan, and the limit runs as a top-k in every task.
    """
    rows = vectors if where is None else vectors.where(where)
    scored = rows.withColumn("score", cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))
    return scored.where("score is not null").orderBy(F.desc("score"), key).limit(k)


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a column of lists as rows of a matrix, with the places of those that are no null."""
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(at), -1) if len(at) else np.zeros((0, 1)), at


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are no zero vector, at length one, and their places."""
    size = np.linalg.norm(x, axis=1)
    at = np.flatnonzero(size > 0)
    return x[at] / size[at, None], at


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest scores of each row and their ids, in order, ties by id."""
    k = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    row, column = np.nonzero(scores >= least[:, None])
    order = np.lexsort((ids[row, column], -scores[row, column], row))
    row, column = row[order], column[order]
    chosen = np.arange(len(row)) - np.searchsorted(row, row) < k
    shape = (len(scores), k)
    return scores[row[chosen], column[chosen]].reshape(shape), ids[row[chosen], column[chosen]].reshape(shape)


class Nearest:
    """The best ``k`` rows met so far for each of the query vectors."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.scores, self.ids = np.zeros((len(queries), 0)), None

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, SCORES // max(1, len(self.queries)))
        for at in range(0, len(vectors), step):
            part, names = vectors[at : at + step], ids[at : at + step]
            scores = np.round(self.queries @ part.T, 12)
            names = np.broadcast_to(names, scores.shape)
            if self.ids is not None:
                scores, names = np.concatenate([self.scores, scores], 1), np.concatenate([self.ids, names], 1)
            self.scores, self.ids = best_of(scores, names, self.k)


def key_values(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), str) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.to_numpy(zero_copy_only=False)


def search_all(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int | None = None) -> DataFrame:
    """(query_id, key, score, rank): the exact ``k`` nearest rows of every query, by blocks of queries.

    Each pass broadcasts at most ``block`` query vectors (``QUERY_BYTES`` of them by default); every task keeps the
    best ``k`` of its rows, so a query brings k rows a task to the last step. Zero and null vectors are left out.
    """
    kind = vectors.schema[key].dataType.simpleString()
    queries = queries.where(F.col(vector).isNotNull()).select(key, vector)
    count, width = queries.agg(F.count("*"), F.max(F.size(vector))).first()
    n = -(-count // (block or max(1, QUERY_BYTES // (8 * (width or 1))))) or 1
    found = None
    for part in range(n):
        chosen = queries if n == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == part)
        rows = chosen.orderBy(key).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        asked, at = unit_rows(numbers(rows.column(vector).combine_chunks())[0])
        shared = vectors.sparkSession.sparkContext.broadcast((key_values(rows.column(key).combine_chunks())[at], asked))

        def work(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, asked = shared.value
            best = Nearest(asked, k)
            for batch in batches:
                x, valid = numbers(batch.column(vector))
                x, solid = unit_rows(x)
                best.add(key_values(batch.column(key))[valid[solid]], x)
            if best.ids is not None and len(asked):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.ids.shape[1])), pa.array(best.ids.ravel()), pa.array(best.scores.ravel())], ["query_id", key, "score"])

        part_found = vectors.select(key, vector).mapInArrow(work, f"query_id {kind}, {key} {kind}, score double")
        found = part_found if found is None else found.unionByName(part_found)
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, {key} {kind}, score double, rank int")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def replace_documents(points: DataFrame, new: DataFrame, touched: DataFrame, keys: Sequence[str] = ("user_id", "doc_id")) -> DataFrame:
    """The points after the touched documents got their new ones; a touched document without new points loses all."""
    return points.join(touched.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def stale_points(points: DataFrame, new: DataFrame, keys: Sequence[str] = ("user_id", "doc_id"), point: str = "chunk_id") -> DataFrame:
    """Points of the documents in ``new`` whose id is not among the new ones."""
    own = points.join(new.select(*keys).distinct(), list(keys), "left_semi")
    return own.join(new.select(*keys, point), [*keys, point], "left_anti")


def whole_documents(documents: DataFrame, chunks: DataFrame, points: DataFrame, keys: Sequence[str] = ("user_id", "doc_id")) -> DataFrame:
    """The documents that have as many points as chunks; one that has neither is whole."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    both = documents.join(count(chunks, "_chunks"), list(keys), "left").join(count(points, "_points"), list(keys), "left")
    return both.where(F.coalesce("_chunks", F.lit(0)) == F.coalesce("_points", F.lit(0))).drop("_chunks", "_points")


def retrieval_quality(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """(n_queries, hit_at_k, mrr) of ``ranked`` (query_id, item, rank) against ``truth`` (query_id, item)."""
    good = ranked.join(truth.select("query_id", "item").distinct(), ["query_id", "item"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("best"))
    asked = truth.select("query_id").distinct().join(good, "query_id", "left")
    return asked.agg(F.count("*").alias("n_queries"), F.round(F.avg(F.when(F.col("best").isNotNull(), 1.0).otherwise(0.0)), 6).alias("hit_at_k"), F.round(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), 6).alias("mrr"))
