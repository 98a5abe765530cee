"""Language of a text by character trigrams: multinomial naive Bayes over the configured languages.

The trigram counts are one aggregate over all labelled rows; the model keeps the ``most`` most frequent
trigrams, which bounds what is collected and broadcast. Texts are scored a block at a time: their code
points form one array, trigrams are numbers, and scores are gathered and summed by row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

MOST = 20_000
#: Code points worked on at a time.
BLOCK = 1 << 20


def gram_numbers(codes: np.ndarray) -> np.ndarray:
    """The number of the three code points that begin at each place but the last two."""
    c = codes.astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and where each text begins."""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    whole = "".join(texts.to_pylist()) if len(texts) else ""
    return np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def framed(texts: pa.Array) -> pa.Array:
    """Lower-case texts with everything but letters as one space, and a space at both ends."""
    plain = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " "))
    return pc.binary_join_element_wise(" ", plain, " ", "")


def grams_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of all framed texts as numbers, and the text each belongs to."""
    codes, starts = code_points(texts)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = gram_numbers(codes)
    row = np.searchsorted(starts, np.arange(len(grams)), "right") - 1
    inside = np.arange(len(grams)) + 2 < starts[row + 1]
    return grams[inside], row[inside]


def spelt(grams: np.ndarray) -> list[str]:
    """The trigrams as text."""
    codes = np.stack([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF], 1).astype("<u4")
    whole = codes.tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[i : i + 3] for i in range(0, len(whole), 3)]


def cut_blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``BLOCK`` code points."""
    ends = np.cumsum(pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        yield at, to
        at = to


def trigram_counts(df: DataFrame, text: str, label: str) -> DataFrame:
    """(label, gram, n): over lower-case texts with everything but letters as one space; counted in the workers first. Null texts and labels count nothing."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in cut_blocks(batch.column("text")):
                names = batch.column("label").slice(at, to - at).dictionary_encode()
                grams, row = grams_of(framed(batch.column("text").slice(at, to - at)))
                number = names.indices.to_numpy(zero_copy_only=False)[row]
                for k, name in enumerate(names.dictionary.to_pylist()):
                    found, n = np.unique(grams[number == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(spelt(found), pa.string()), pa.array(n)], ["label", "gram", "n"])

    rows = df.select(F.col(label).alias("label"), F.col(text).alias("text")).where("text is not null and label is not null")
    return rows.mapInArrow(work, "label string, gram string, n bigint").groupBy("label", "gram").agg(F.sum("n").alias("n"))


class TrigramModel:
    def __init__(self, counts: DataFrame, languages: tuple[str, ...], most: int = MOST):
        self.languages = languages
        known = counts.where(F.col("label").isin(*languages))
        top = known.groupBy("gram").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "gram").limit(most).select("gram")
        rows = known.join(F.broadcast(top), "gram").collect()
        grams = sorted({r["gram"] for r in rows})
        table = np.full((len(grams), len(languages)), 0.5)
        place = {g: i for i, g in enumerate(grams)}
        for r in rows:
            table[place[r["gram"]], languages.index(r["label"])] += r["n"]
        scores = np.log(table / table.sum(0)) if rows else table
        keys = gram_numbers(np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32))[::3] if rows else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.keys, self.scores = keys[order], scores[order]

    def classify(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the likeliest language of each text, and its share of the likelihood."""
        total = np.zeros((len(texts), len(self.languages)))
        grams, row = grams_of(framed(texts))
        if len(grams) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == grams)
            for k in range(len(self.languages)):
                total[:, k] = np.bincount(row[hit], self.scores[at[hit], k], len(texts))
        p = np.exp(total - total.max(1, keepdims=True))
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best] / p.sum(1)

    def detect_all(self, texts: pa.Array, min_chars: int = 20, min_confidence: float = 0.8) -> pa.Array:
        """The language of each text; null for null, for under ``min_chars`` letters and for a guess under ``min_confidence``."""
        out = []
        for at, to in cut_blocks(texts):
            part = texts.slice(at, to - at).fill_null("")
            letters = pc.utf8_length(pc.replace_substring_regex(part, r"[^\p{L}]+", "")).to_numpy(zero_copy_only=False)
            best, confidence = self.classify(part)
            unsure = (letters < max(min_chars, 1)) | ~(confidence >= min_confidence)
            out.append(pa.array(np.array(self.languages, object)[best], pa.string(), mask=unsure))
        return pa.chunked_array(out, pa.string()).combine_chunks()

    def detect(self, text: str | None, min_chars: int = 20, min_confidence: float = 0.8) -> str | None:
        return self.detect_all(pa.array([text], pa.string()), min_chars, min_confidence)[0].as_py()

    def column(self, text: Column, min_chars: int = 20, min_confidence: float = 0.8) -> Column:
        model = self

        @F.pandas_udf("string")
        def detected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield model.detect_all(pa.array(texts, pa.string(), from_pandas=True), min_chars, min_confidence).to_pandas()

        return detected(text)
