"""Problem 6: items over a size limit, cut into overlapping pieces at natural boundaries.

Every word end of an oversized text is a possible cut. Each is joined to the farthest legal next
cut - within both limits once the shared words are counted, at a paragraph, else a line, else a
sentence, else a word - which gives a successor table. Squaring that table (pointer doubling)
marks all cuts that the greedy walk would make in about log2(pieces) gathers, for all the texts
of a block at once.

Words are runs between blanks. A word longer than the character limit is cut inside. Neighbours
share ``overlap`` words, fewer only where so many would leave no room for a new word. Null and empty
texts are never oversized; a blank one over the character limit has one empty piece. Items stored
several times come out once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.codepoints import BLANK, blocks, classes, decode, encode, runs, spread

MAX_WORDS, MAX_CHARS, OVERLAP = 450, 4000, 40
WORD, SENTENCE, LINE, PARAGRAPH, END = range(5)
ITEM = "kind string, user_id string, doc_id string, page int, part int"
# Signs that end a sentence, and those that may close it after them.
STOPS, CLOSERS = ".!?…。！？", "\"')]}»”’"


def _fragments(starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words over ``limit`` code points cut every ``limit``."""
    n = np.maximum(1, -(-(ends - starts) // limit))
    if (n == 1).all():
        return starts, ends, rows
    place = spread(np.zeros(len(n), np.int64), n)
    a = np.repeat(starts, n) + place * limit
    return a, np.minimum(a + limit, np.repeat(ends, n)), np.repeat(rows, n)


def cuts(codes: np.ndarray, offsets: np.ndarray, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, piece number, start, end and word count of all pieces of the rows that hold a word and are over a limit."""
    if not 0 <= overlap < max_words or max_chars < 1:
        raise ValueError("the overlap must be smaller than the word limit, and the character limit positive")
    empty = np.zeros(0, np.int64)
    blank = (classes()[codes] & BLANK) > 0
    a, b = runs(~blank, offsets)
    rows = np.searchsorted(offsets, a, "right") - 1
    n_words = np.bincount(rows, minlength=len(offsets) - 1)
    over = (n_words > max_words) | (np.diff(offsets) > max_chars) & (n_words > 0)
    if not over.any():
        return empty, empty, empty, empty, empty
    keep = over[rows]
    a, b, rows = _fragments(a[keep], b[keep], rows[keep], max_chars)
    n = len(a)
    last = np.ones(n, bool)
    last[:-1] = rows[1:] != rows[:-1]
    row_end = np.flatnonzero(last)[np.cumsum(np.concatenate([[0], last[:-1]])).astype(np.int64)]  # index of the row's last word
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    row_first = np.repeat(first, np.diff(np.append(first, n)))
    # strength of a cut after each word
    feeds = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(codes == 10, out=feeds[1:])
    gap_to = np.append(a[1:], b[-1:])
    n_feeds = feeds[np.maximum(gap_to, b)] - feeds[b]
    tail = codes[b - 1]
    before = codes[np.maximum(b - 2, 0)]
    stops, closers = np.array([ord(c) for c in STOPS], np.uint32), np.array([ord(c) for c in CLOSERS], np.uint32)
    strength = np.where(np.isin(tail, stops) | np.isin(tail, closers) & np.isin(before, stops), SENTENCE, WORD)
    strength = np.where(n_feeds >= 2, PARAGRAPH, np.where(n_feeds == 1, LINE, strength))
    strength[last] = END
    index = np.arange(n)
    latest = {s: np.maximum.accumulate(np.where(strength >= s, index, -1)) for s in (PARAGRAPH, LINE, SENTENCE)}

    def farthest(start: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The last word of the best piece from word ``start`` that ends behind word ``after``."""
        to = np.minimum(start + max_words - 1, np.searchsorted(b, a[start] + max_chars, "right") - 1)
        to = np.minimum(to, row_end[start])
        best = np.full(len(start), -1)
        half = np.maximum(after, start + (to - start) // 2)
        for least in (half, np.maximum(after, start + overlap)):
            for s in (PARAGRAPH, LINE, SENTENCE):
                cut = latest[s][to]
                best = np.where((best < 0) & (cut > least), cut, best)
        return np.where(to == row_end[start], to, np.where(best < 0, np.maximum(to, after + 1), best))

    # the piece after a cut behind word e starts overlap words back, or later where no new word would fit
    nxt = np.minimum(index + 1, row_end)
    start = np.maximum(index + 1 - overlap, row_first)
    # shared words take at most half of the characters, so that every piece moves on
    fits = np.maximum(np.searchsorted(a, b[nxt] - max_chars, "left"), np.searchsorted(a, b - max_chars // 2, "left"))
    start = np.minimum(np.maximum(np.maximum(start, fits), nxt - max_words + 1), nxt)
    succ = np.where(last, index, farthest(start, index))
    reached = farthest(first, first - 1)
    jump = succ
    while True:
        more = np.unique(np.concatenate([reached, jump[reached]]))
        if len(more) == len(reached):
            break
        reached, jump = more, jump[jump]
    reached = np.unique(reached)
    piece_row = rows[reached]
    is_first = np.ones(len(reached), bool)
    is_first[1:] = piece_row[1:] != piece_row[:-1]
    begin = np.where(is_first, row_first[reached], start[np.concatenate([[0], reached[:-1]])])
    number = np.arange(len(reached)) - np.maximum.accumulate(np.where(is_first, np.arange(len(reached)), 0))
    return piece_row, number, a[begin], b[reached], reached - begin + 1


def items(pages: DataFrame, chunks: DataFrame, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Pages (part -1) and stored chunks as items; texts too short to be over a limit stay in the JVM."""
    least = min(2 * max_words, max_chars)  # more than max_words words need at least 2 * max_words + 1 code points
    p = pages.select(F.lit("page").alias("kind"), "user_id", "doc_id", F.col("number").alias("page"), F.lit(-1).alias("part"), "text")
    c = chunks.select(F.lit("chunk").alias("kind"), "user_id", "doc_id", "page", "part", "text")
    return p.unionByName(c).where(F.length("text") > least)


def pieces(df: DataFrame, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, texts: bool = True) -> DataFrame:
    """(kind, user_id, doc_id, page, part, piece, n_words, n_chars[, text]) of the items over a limit."""
    schema = f"{ITEM}, piece int, n_words int, n_chars int" + ", text string" * texts
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            codes, offsets = decode(block.column("text"))
            row, number, a, b, n = cuts(codes, offsets, max_words, max_chars, overlap)
            # blank texts over the limit hold no word to cut at: one empty piece each
            blank = np.setdiff1d(np.flatnonzero(np.diff(offsets) > max_chars), row)
            none = np.zeros(len(blank), np.int64)
            row, number, n = (np.concatenate(x) for x in ((row, blank), (number, none), (n, none)))
            a, b = np.concatenate([a, offsets[blank]]), np.concatenate([b, offsets[blank]])
            if not len(row):
                continue
            out = [*block.select(names[:5]).take(pa.array(row)).columns, pa.array(number, pa.int32()), pa.array(n, pa.int32()), pa.array(b - a, pa.int32())]
            if texts:
                out.append(encode(codes[spread(a, b - a)], np.concatenate([[0], np.cumsum(b - a)])))
            yield pa.RecordBatch.from_arrays(out, names)

    out = df.select(*names[:5], "text").mapInArrow(work, schema)
    return out.dropDuplicates([*names[:5], "piece", "n_words", "n_chars", *["text"] * texts])


def found_items(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kind, user_id, doc_id, page, part): the items that had to be cut, each once."""
    cut = pieces(items(pages, chunks), texts=False)
    return cut.groupBy("kind", "user_id", "doc_id", "page", "part").agg(F.max("piece").alias("_last")).drop("_last")
