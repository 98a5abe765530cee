"""Problem 7: token ids of every text by a public byte-level tokenizer.

Texts are cut at content-defined places: a rolling hash over the code points before a possible cut
decides, so a passage that documents share is cut alike wherever it stands. A task encodes each
distinct chunk once and assembles the ids of its texts from the chunk dictionary by gathers.
A cut chosen by the hash is moved to the next place where a blank run begins after a non-blank.

Joins are then repaired: for each distinct join of a task, what lies from the nearest such place
before it to the next one behind it is encoded whole and in its two halves. Where these disagree, the
chunks of that text are re-encoded with their neighbours and merged until they agree. For patterns that
never join across a blank after a non-blank, as that of the default tokenizer, all agree at once.

The empty list stands for null and for empty texts. Strings of special tokens in a text are
ordinary text. Texts without blanks are encoded whole.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.codepoints import BLANK, blocks, classes, decode, hash_ranges, mix, row_of, spread

TOKENIZERS = "/opt/tokenizers"
WINDOW, MASK = 16, np.uint64(0x7 << 40)
#: Bounds of a task's chunk dictionary; it starts anew beyond them.
MAX_CHUNKS, MAX_IDS = 200_000, 4_000_000
_BASE = 0x5851F42D4C957F2D


@lru_cache(2)
def encoder(name: str, folder: str):
    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = _BASE, pow(_BASE, -1, 1 << 64)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def safe_places(codes: np.ndarray) -> np.ndarray:
    """Where a space or a line feed follows a non-blank."""
    blank = (classes()[codes] & BLANK) > 0
    safe = ((codes == 32) | (codes == 10))
    safe[1:] &= ~blank[:-1]
    safe[:1] = False
    return np.flatnonzero(safe)


def cut_places(codes: np.ndarray, offsets: np.ndarray, mask: np.uint64 = MASK, anywhere: bool = False) -> np.ndarray:
    """Starts of the chunks of non-empty rows, row starts included; each other one depends on the WINDOW code points before it."""
    n = len(codes)
    at = np.arange(n) if anywhere else safe_places(codes)
    row_start = offsets[np.searchsorted(offsets, at, "right") - 1]
    at = at[at - row_start >= WINDOW]
    up, down = _powers(1 << max(12, int(n).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) * up[:n], out=total[1:])
    rolled = (total[at] - total[at - WINDOW]) * down[at]
    at = at[((rolled ^ (rolled >> np.uint64(29))) & mask) == 0]
    rows = offsets[:-1][np.diff(offsets) > 0]
    return np.unique(np.concatenate([rows, at]))


class ChunkDictionary:
    """Ids of the chunks met so far; every distinct chunk is encoded once until a bound is reached."""

    def __init__(self, encoding):
        self.encode = encoding.encode_ordinary
        self.widths = np.zeros(encoding.n_vocab, np.int64)
        for token, rank in encoding._mergeable_ranks.items():
            self.widths[rank] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.pool, self.begin, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.joins: dict[int, bool] = {}

    def _encoded(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks and their numbers, in one call for all.

        A line feed is put before each chunk; the ids are dealt out by the bytes they stand for. It
        stays a token of its own between two non-blanks, and a chunk that begins with a blank needs
        none. Chunks that end in a blank, or begin a text with one, are encoded alone.
        """
        blank = (classes()[codes] & BLANK) > 0
        head, tail = blank[starts], blank[ends - 1]
        # a chunk that starts with one single blank met a non-blank before it when it was cut
        alone = tail | head & ((codes[starts] != 32) & (codes[starts] != 10))
        together = np.flatnonzero(~alone)
        n = np.zeros(len(starts), np.int64)
        parts: dict[int, list[int]] = {}
        text = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        for k in np.flatnonzero(alone).tolist():
            parts[k] = self.encode(text[starts[k] : ends[k]])
            n[k] = len(parts[k])
        ids = np.zeros(0, np.int32)
        if together.size:
            a, b = starts[together], ends[together]
            feeds = (~head[together]).astype(np.int64)
            sizes = b - a + feeds
            line = np.full(int(sizes.sum()), 10, np.uint32)
            at = np.cumsum(sizes) - sizes + feeds
            line[spread(at, b - a)] = codes[spread(a, b - a)]
            ids = np.array(self.encode(line.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")), np.int32)
            widths = 1 + (line >= 0x80).astype(np.int64) + (line >= 0x800) + (line >= 0x10000)
            byte_ends = np.cumsum(widths)
            first_byte = byte_ends[at] - widths[at]
            token_starts = np.append(0, np.cumsum(self.widths[ids]))
            last_byte = byte_ends[at + (b - a) - 1]
            from_, to = np.searchsorted(token_starts, first_byte), np.searchsorted(token_starts, last_byte)
            # a token that crosses an end of a chunk: those chunks are encoded alone
            whole = (token_starts[from_] == first_byte) & (token_starts[to] == last_byte)
            for k in together[~whole].tolist():
                parts[k] = self.encode(text[starts[k] : ends[k]])
                n[k] = len(parts[k])
            together, from_, to = together[whole], from_[whole], to[whole]
            n[together] = to - from_
            ids = ids[spread(from_, to - from_)]
        if not parts:
            return ids, n
        out = np.zeros(int(n.sum()), np.int32)
        begin = np.cumsum(n) - n
        out[spread(begin[together], n[together])] = ids
        for k, x in parts.items():
            out[begin[k] : begin[k] + len(x)] = x
        return out, n

    def look_up(self, codes: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in order, and the number of each chunk's ids."""
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.place) + len(unique) > MAX_CHUNKS or len(self.pool) > MAX_IDS:
            self._clear()
        place = self.place
        at = np.fromiter((place.get(h, -1) for h in unique.tolist()), np.int64, len(unique))
        new = np.flatnonzero(at < 0)
        if new.size:
            at[new] = np.arange(len(new)) + len(place)
            place.update(zip(unique[new].tolist(), at[new].tolist()))
            ids, n = self._encoded(codes, starts[first[new]], ends[first[new]])
            self.begin = np.append(self.begin, len(self.pool) + np.cumsum(n) - n)
            self.pool, self.lengths = np.append(self.pool, ids), np.append(self.lengths, n)
        chunk = at[inverse]
        n = self.lengths[chunk]
        return self.pool[spread(self.begin[chunk], n)], n


    def agreeing(self, codes: np.ndarray, offsets: np.ndarray, joins: np.ndarray) -> np.ndarray:
        """Whether the ids on both sides of each join are those of the text around it; every distinct surrounding is encoded once."""
        safe = np.unique(np.concatenate([safe_places(codes), offsets]))
        at = np.searchsorted(safe, joins)
        low, high = safe[at - 1], safe[np.searchsorted(safe, joins, "right")]
        hashes = mix(hash_ranges(codes, low, high) + (joins - low).astype(np.uint64))
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.joins) + len(unique) > MAX_CHUNKS:
            self.joins.clear()
        text, known = None, self.joins
        for h, k in zip(unique.tolist(), first.tolist()):
            if h not in known:
                if text is None:
                    text = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                left, right = text[low[k] : joins[k]], text[joins[k] : high[k]]
                known[h] = self.encode(left + right) == self.encode(left) + self.encode(right)
        return np.fromiter((known[h] for h in unique.tolist()), bool, len(unique))[inverse]

    def ids(self, codes: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a block cut at ``starts``, one row after the other, and the offsets of the rows among them."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(codes)).astype(np.int64)
        ids, n = self.look_up(codes, hash_ranges(codes, starts, ends), starts, ends)
        first = np.searchsorted(starts, offsets, "left")
        total = np.concatenate([[0], np.cumsum(n)])[first]
        joins = np.setdiff1d(starts, offsets)
        wrong = np.unique(row_of(offsets, joins[~self.agreeing(codes, offsets, joins)])) if len(joins) else joins
        if not len(wrong):
            return ids, total
        text = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        rows = [ids[a:b] for a, b in zip(total, total[1:])]
        for r in wrong.tolist():
            rows[r] = np.array(repaired([text[starts[k] : ends[k]] for k in range(first[r], first[r + 1])], self.encode), np.int32)
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])


def repaired(parts: list[str], encode) -> list[int]:
    """Ids of the joined parts: at each join the neighbours are re-encoded together and merged until both agree."""
    done: list[str] = []
    for part in parts:
        done.append(part)
        while len(done) > 1 and encode(done[-2] + done[-1]) != encode(done[-2]) + encode(done[-1]):
            done[-2:] = [done[-2] + done[-1]]
    return [i for part in done for i in encode(part)]


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids array<int>): one narrow pass, no shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = ChunkDictionary(encoder(tokenizer, folder))
        for block in blocks(batches, text):
            codes, offsets = decode(block.column(text))
            ids, total = dictionary.ids(codes, offsets, cut_places(codes, offsets))
            lists = pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([block.column(key), lists], [key, "ids"])

    return df.select(key, text).mapInArrow(work, f"{key} {kind}, ids array<int>")
