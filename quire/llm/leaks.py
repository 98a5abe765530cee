"""Problem 8: passages of held-out texts inside corpus documents.

Each shard of the corpus (a block of rows in a task) becomes an FM-index over words: a sequence of
word symbols, its suffixes in order, the Burrows-Wheeler transform in a wavelet tree, and sampled
suffix positions. Backward search runs all test phrases of ``MIN_WORDS`` words at once through
wavelet-tree ranks; matches are located from the samples and merged to spans.

The alphabet is the vocabulary of the test texts and one sign for all other words, so an index
takes a few bytes a word. Suffixes are ordered by their first ``MIN_WORDS`` symbols, which is all
that a backward search of phrases of that length compares. Words are runs of letters and digits
after folding case, accents and compatibility forms. Words carry 64-bit hashes.

Null, empty and short texts match nothing; an item under ``MIN_WORDS`` words has no phrase. The
test set is searched in blocks of at most ``ITEMS_BLOCK`` phrases, and ``MAX_ITEM_WORDS`` bounds what
is fetched and broadcast at a time: beyond it the corpus is passed over once for each part.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.functions.stages import cut
from quire.llm.codepoints import DIGIT, LETTER, OTHER_NUMBER, CharMap, blocks, classes, decode, hash_ranges, runs, spread, tabulated

MIN_WORDS = 12
SAMPLE = 8
ITEMS_BLOCK = 1 << 16
MAX_ITEM_WORDS = 1 << 20
SHARD_BYTES = 4 << 20


@lru_cache(1)
def fold_map() -> CharMap:
    """Compatibility decomposition without marks, case folded."""
    table = {}
    for code in tabulated():
        char = chr(code)
        out = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", char).casefold())
        out = "".join(c for c in out if unicodedata.category(c) not in ("Mn", "Me"))
        if out != char:
            table[code] = tuple(map(ord, out))
    return CharMap(table)


def folded_words(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of each word, and its start and end among the raw code points."""
    folded, ends, source = fold_map().apply(codes, offsets)
    word = (classes()[folded] & (LETTER | DIGIT | OTHER_NUMBER)) > 0
    a, b = runs(word, ends)
    rows = np.searchsorted(ends, a, "right") - 1
    hashes = hash_ranges(folded, a, b)
    return (hashes, rows, a, b) if source is None else (hashes, rows, source[a], source[b - 1] + 1)


class WaveletTree:
    """Ranks of symbols in a sequence, by bits from the highest: one sorted-in-place level a bit."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for bit in range(bits - 1, -1, -1):
            ones = (sequence >> bit) & 1
            total = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(ones, out=total[1:])
            self.levels.append((total, len(sequence) - int(total[-1])))
            order = ones.astype(bool)
            sequence = np.concatenate([sequence[~order], sequence[order]])

    def rank(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before ``low`` and before ``high``."""
        base = np.zeros(len(symbols), np.int64)
        for level, (ones, zeros) in enumerate(self.levels):
            bit = ((symbols >> (self.bits - 1 - level)) & 1).astype(bool)
            low, high, base = (np.where(bit, zeros + ones[x], x - ones[x]) for x in (low, high, base))
        return low - base, high - base


def suffix_order(sequence: np.ndarray, bits: int) -> np.ndarray:
    """Suffixes of a sequence that ends in its only 0, in order: packed symbols first, then doubling of what is still tied."""
    n = len(sequence)
    width = max(1, 62 // bits)
    padded = np.concatenate([sequence.astype(np.int64), np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(width):
        key = key << bits | padded[i : i + n]
    order = np.argsort(key)
    index = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, index, 0))
    while not new.all():
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        sub = order[at]
        nxt = np.where(sub + width < n, rank[np.minimum(sub + width, n - 1)] + 1, 0)
        key = rank[sub] * (n + 2) + nxt
        by = np.argsort(key)
        sub, key = sub[by], key[by]
        order[at] = sub
        differs = np.ones(len(at), bool)
        differs[1:] = key[1:] != key[:-1]
        new[at] = differs
        rank[sub] = np.maximum.accumulate(np.where(differs, at, 0))
        width *= 2
    return order


class FMIndex:
    """Transform, symbol counts and sampled positions of a sequence of symbols from 1; the suffix order is not kept."""

    def __init__(self, sequence: np.ndarray, n_symbols: int):
        sequence = np.append(sequence, 0).astype(np.int32)
        self.n, bits = len(sequence), max(1, int(n_symbols - 1).bit_length())
        order = suffix_order(sequence, bits)
        self.transform = sequence[order - 1]  # the symbol before each suffix, round the end
        counts = np.bincount(sequence, minlength=n_symbols)
        self.before = np.cumsum(counts) - counts
        self.tree = WaveletTree(self.transform, bits)
        sampled = order % SAMPLE == 0
        self.samples = order[sampled]
        self.sampled = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int32)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals [low, high) of the phrases (one a row), by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            alive = np.flatnonzero(high > low)
            if not alive.size:
                break
            symbols = phrases[alive, column]
            a, b = self.tree.rank(symbols, low[alive], high[alive])
            low[alive], high[alive] = self.before[symbols] + a, self.before[symbols] + b
        return low, np.maximum(low, high)

    def positions(self, at: np.ndarray) -> np.ndarray:
        """Where the suffixes of these places in the order begin: steps back to the next sampled one."""
        found = np.full(len(at), -1, np.int64)
        walk, steps = at.copy(), np.zeros(len(at), np.int64)
        left = np.arange(len(at))
        while left.size:
            here = walk[left]
            hit = self.sampled[here + 1] > self.sampled[here]
            found[left[hit]] = self.samples[self.sampled[here[hit]]] + steps[left[hit]]
            left, here = left[~hit], here[~hit]
            symbol = self.transform[here]
            walk[left] = self.before[symbol] + self.tree.rank(symbol, here, here)[0]
            steps[left] += 1
        return found


class Phrases:
    """All phrases of ``MIN_WORDS`` words of the test texts, as symbols from 2, with the items they stand in."""

    def __init__(self, item_ids: list[int], texts: list[str | None]):
        codes, offsets = decode(pa.array(texts, pa.string()))
        hashes, rows, _, _ = folded_words(codes, offsets)
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        n = max(0, len(rows) - MIN_WORDS + 1)
        window = symbols[np.arange(n)[:, None] + np.arange(MIN_WORDS)] + 2 if n else np.zeros((0, MIN_WORDS), np.int64)
        whole = rows[:n] == rows[MIN_WORDS - 1 :] if n else np.zeros(0, bool)
        self.phrases, inverse = np.unique(window[whole], axis=0, return_inverse=True)
        owner = np.array(item_ids, np.int64)[rows[:n][whole]] if n else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([inverse.ravel(), owner]), axis=1) if n else np.zeros((2, 0), np.int64)
        self.items = pairs[1]
        self.first = np.searchsorted(pairs[0], np.arange(len(self.phrases) + 1))

    def matches(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, item, first and last code point (exclusive) of each merged span of a block of texts."""
        none = np.zeros(0, np.int64)
        hashes, rows, a, b = folded_words(codes, offsets)
        if not len(hashes) or not len(self.phrases):
            return none, none, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        symbols = np.where(self.vocabulary[at] == hashes, at + 2, 1)
        # the sign for other words stands between rows too, and once for each run of such words
        gap = np.ones(len(rows), bool)
        gap[1:] = rows[1:] != rows[:-1]
        known = symbols > 1
        keep = known | gap
        keep[1:] |= known[:-1]
        place = np.flatnonzero(keep)
        extra = (gap & known)[place].astype(np.int64)  # a separator before a row that begins with a known word
        sequence = np.ones(len(place) + int(extra.sum()), np.int64)
        to = np.arange(len(place)) + np.cumsum(extra)
        sequence[to] = symbols[place]
        word = np.zeros(len(sequence), np.int64)
        word[to] = place
        index = FMIndex(sequence, len(self.vocabulary) + 2)
        which, starts = [], []
        for k in range(0, len(self.phrases), ITEMS_BLOCK):
            low, high = index.search(self.phrases[k : k + ITEMS_BLOCK])
            which.append(np.repeat(np.arange(len(low)) + k, high - low))
            starts.append(index.positions(spread(low, high - low)))
        which, starts = np.concatenate(which), word[np.concatenate(starts)]
        if not len(which):
            return none, none, none, none
        n = self.first[which + 1] - self.first[which]
        item = self.items[spread(self.first[which], n)]
        begin = np.repeat(starts, n)
        order = np.lexsort((begin, item, rows[begin]))
        item, begin = item[order], begin[order]
        row = rows[begin]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > begin[:-1] + MIN_WORDS)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1
        return row[first], item[first], a[begin[first]] - offsets[row[first]], b[begin[last] + MIN_WORDS - 1] - offsets[row[first]]


def item_parts(items: DataFrame) -> list[DataFrame]:
    """The test texts in parts of at most ``MAX_ITEM_WORDS`` words and one text each, told from their measured sizes."""
    texts = items.select("item_id", "text").where("item_id is not null and length(text) > 0").distinct()
    total, longest = texts.agg(F.sum(F.length("text")), F.max(F.length("text"))).first()
    # a word and what stands before it take two code points at least; a single text may be over the bound
    most, n = 2 * MAX_ITEM_WORDS + (longest or 0), 1
    while (total or 0) > most:
        n *= 2
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        total = texts.groupBy(part.alias("part")).agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0]
    return [texts] if n == 1 else [texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first, last): code-point spans of leaked passages; first counts from 0, last is exclusive.

    One part of the test texts is on the driver at a time. Where there are several, each is searched for,
    its spans are written to the shared folder, and its broadcast is given up before the next.
    """
    spark = documents.sparkSession

    def searched(part: DataFrame):
        rows = part.toPandas()
        shared = spark.sparkContext.broadcast(Phrases(rows["item_id"].tolist(), rows["text"].tolist()))

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, "text", limit=SHARD_BYTES):
                row, item, a, b = shared.value.matches(*decode(block.column("text")))
                ids = block.column("doc_id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(item), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["doc_id", "item_id", "first", "last"])

        return documents.select("doc_id", "text").mapInArrow(work, "doc_id bigint, item_id bigint, first int, last int"), shared

    parts = item_parts(items)
    if len(parts) == 1:
        return searched(parts[0])[0]
    done = []
    for part in parts:
        found, shared = searched(part)
        done.append(cut(found))
        shared.unpersist()
    return reduce(DataFrame.unionByName, done)


def found_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id), each once."""
    return spans(documents, items).select("doc_id", "item_id").distinct()


def removal_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, first, last, items): the union of a document's leaked spans, overlapping ones merged.

    The spans of one document are bounded by its words and are merged inside its own group.
    """
    s = F.struct("first", "last")
    merged = F.aggregate(
        F.array_sort(F.collect_set(s)),
        F.expr("cast(array() as array<struct<first:int,last:int>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["last"] >= x["first"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], x["last"]).alias("last"))))).otherwise(F.concat(acc, F.array(x))),
    )
    grouped = spans(documents, items).groupBy("doc_id").agg(merged.alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    return grouped.select("doc_id", F.explode("spans").alias("s"), "items").select("doc_id", "s.first", "s.last", "items")
