"""Problem 2: lines that stand in many documents of one source.

Lines are hashed after reading their characters as problem 1 does, lower-casing, dropping blanks
and taking a run of digits as one sign. Documents are counted for each (source, hash) over all
pages; a line is frequent when at least ``min_share`` of the source's documents and at least
``min_documents`` hold it. Frequent lines are then found again on the pages by a join.

Null and empty texts hold no line. A page that is stored several times counts once, since
documents and places are counted as distinct keys. Pages whose document is not in the manifest
have no source and hold no frequent line. A document moved between sources counts for the latest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.functions.stages import checked_join, written
from quire.functions.tables import latest_rows
from quire.llm.codepoints import BLANK, DIGIT, LETTER, CharMap, blocks, classes, decode, hash_ranges, tabulated
from quire.llm.lookalikes import normalise

MIN_SHARE, MIN_DOCUMENTS, MIN_LETTERS = 0.15, 6, 10
LINE_SCHEMA = "user_id string, doc_id string, number int, line_no int, line_hash bigint"


@lru_cache(1)
def lower_map() -> CharMap:
    return CharMap({c: tuple(map(ord, chr(c).lower())) for c in tabulated() if chr(c).lower() != chr(c)})


def line_hashes(codes: np.ndarray, offsets: np.ndarray, min_letters: int = MIN_LETTERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, line number from 1 and hash of every line of raw texts with at least ``min_letters`` letters."""
    return normal_line_hashes(*normalise(codes, offsets)[:2], min_letters)


def normal_line_hashes(codes: np.ndarray, offsets: np.ndarray, min_letters: int = MIN_LETTERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of texts whose characters are in one form already."""
    codes, offsets, _ = lower_map().apply(codes, offsets)
    kinds = classes()[codes]
    n = len(offsets) - 1
    feeds = np.flatnonzero(codes == 10)
    # each row has one line more than it has line feeds; a line starts at the row's start or after a feed
    feed_rows = np.searchsorted(offsets, feeds, "right") - 1
    per_row = np.bincount(feed_rows, minlength=n) + 1
    first = np.cumsum(per_row) - per_row
    starts = np.empty(int(per_row.sum()), np.int64)
    is_first = np.zeros(len(starts), bool)
    is_first[first] = True
    starts[is_first], starts[~is_first] = offsets[:-1], feeds + 1
    rows = np.repeat(np.arange(n), per_row)
    numbers = np.arange(len(starts)) - np.repeat(first, per_row) + 1
    keep = (kinds & BLANK) == 0
    kept_before = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(keep, out=kept_before[1:])
    small, small_kinds = codes[keep], kinds[keep]
    line_of = np.repeat(np.arange(len(starts)), np.diff(np.append(kept_before[starts], len(small))))
    digit = (small_kinds & DIGIT) > 0
    again = digit.copy()
    again[1:] &= digit[:-1] & (line_of[1:] == line_of[:-1])
    if len(again):
        again[0] = False
    small = np.where(digit, np.uint32(48), small)[~again]
    line_of, small_kinds = line_of[~again], small_kinds[~again]
    letters = np.bincount(line_of[(small_kinds & LETTER) > 0], minlength=len(starts))
    lengths = np.bincount(line_of, minlength=len(starts))
    ends = np.cumsum(lengths)
    wanted = letters >= min_letters
    hashes = hash_ranges(small, (ends - lengths)[wanted], ends[wanted])
    return rows[wanted], numbers[wanted], hashes.view(np.int64)


def page_lines(pages: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(user_id, doc_id, number, line_no, line_hash) of every line with enough letters."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            rows, numbers, hashes = line_hashes(*decode(block.column("text")), min_letters)
            out = block.select(["user_id", "doc_id", "number"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(numbers, pa.int32()), pa.array(hashes)], ["user_id", "doc_id", "number", "line_no", "line_hash"])

    return pages.select("user_id", "doc_id", "number", "text").mapInArrow(work, LINE_SCHEMA)


def document_sources(manifest: DataFrame) -> DataFrame:
    """(user_id, doc_id, source): each document once, with the source of its latest row."""
    rows = manifest.select("user_id", "doc_id", "updated_at", "source").where("user_id is not null and doc_id is not null")
    return latest_rows(rows, ["user_id", "doc_id"], ["updated_at"]).select("user_id", "doc_id", "source").where("source is not null")


def frequent_among(lines: DataFrame, sources: DataFrame, min_share: float = MIN_SHARE, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(source, line_hash, n_documents, n_source): the frequent ones of ``lines`` (user_id, doc_id, line_hash).

    A source has at most (lines of its mean document) / ``min_share`` of them. Counting goes over
    (source, line, document), so no source or line is gathered in one task.
    """
    sizes = sources.groupBy("source").agg(F.count("*").alias("n_source"))
    # each line of a document once before the join: combined on the map side
    each = lines.groupBy("user_id", "doc_id", "line_hash").agg(F.lit(1).alias("one"))
    counted = each.join(sources, ["user_id", "doc_id"]).groupBy("source", "line_hash").agg(F.count("*").alias("n_documents"))
    # documents below the absolute bound can never reach the share; drop them before the second join
    counted = counted.where(F.col("n_documents") >= min_documents)
    return counted.join(sizes, "source").where(F.col("n_documents") >= F.col("n_source") * F.lit(min_share))


def frequent_lines(pages: DataFrame, manifest: DataFrame, min_share: float = MIN_SHARE, min_documents: int = MIN_DOCUMENTS, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(source, line_hash, n_documents, n_source): the frequent lines of every source."""
    return frequent_among(page_lines(pages, min_letters), document_sources(manifest), min_share, min_documents)


def found_places(pages: DataFrame, manifest: DataFrame, min_share: float = MIN_SHARE, min_documents: int = MIN_DOCUMENTS, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(user_id, doc_id, number, line_no): every place of a frequent line, each once; texts are read and hashed once."""
    lines, sources = written(page_lines(pages, min_letters)), document_sources(manifest)
    frequent = frequent_among(lines, sources, min_share, min_documents).select("source", "line_hash")
    hits = checked_join(lines.join(sources, ["user_id", "doc_id"]), frequent, ["source", "line_hash"])
    return hits.select("user_id", "doc_id", "number", "line_no").distinct()


def cleaned_pages(pages: DataFrame, manifest: DataFrame, **limits: float) -> DataFrame:
    """(user_id, doc_id, number, text, n_removed): each page once, its text without frequent lines.

    Null texts stay null. The rows of removed lines of a page are bounded by its own lines.
    """
    keys = ["user_id", "doc_id", "number"]
    places = found_places(pages, manifest, **limits)
    gone = places.groupBy(*keys).agg(F.collect_set("line_no").alias("gone"))
    each = pages.groupBy(*keys).agg(F.max("text").alias("text"))
    joined = each.join(gone, keys, "left")
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(~F.array_contains("gone", (i + 1).cast("int")), x)), lambda x: x.isNotNull())
    return joined.select(*keys, F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
