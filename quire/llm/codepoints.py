"""Arrow text as numpy code-point arrays.

Every text operator of this subpackage works on one flat ``uint32`` array of
code points for a block of rows plus row offsets, so the per-character work is
table gathers and prefix sums and never a Python call for each row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points whose properties are tabulated; the rest (unified ideographs and the like) map to themselves.
TABLE_RANGES = ((0, 0x3400), (0xA640, 0xAC00), (0xF900, 0x10000), (0x1D400, 0x1D800), (0x1EE00, 0x1EF00), (0x1F100, 0x1F200), (0x2F800, 0x2FA20), (0xE0000, 0xE01F0))
N_CODES = 0x110000
#: Bytes of text worked on at a time; bounds a worker's memory whatever the size of an Arrow batch.
BLOCK_BYTES = 1 << 20

LETTER, DIGIT, MARK, BLANK, UPPER, LATIN, OTHER_NUMBER = 1, 2, 4, 8, 16, 32, 64


def tabulated() -> Iterator[int]:
    for low, high in TABLE_RANGES:
        yield from range(low, high)


@lru_cache(1)
def classes() -> np.ndarray:
    """Bit flags by code point: LETTER, DIGIT, MARK, BLANK, UPPER, LATIN, OTHER_NUMBER."""
    table = np.zeros(N_CODES, np.uint8)
    for low, high in ((0x3400, 0xA640), (0xAC00, 0xD7A4), (0x20000, 0x2FFFF), (0x30000, 0x32000)):
        table[low:high] = LETTER
    for code in tabulated():
        char, flags = chr(code), 0
        category = unicodedata.category(char)
        if category[0] == "L":
            flags |= LETTER
            if category in ("Lu", "Lt"):
                flags |= UPPER
            if unicodedata.name(char, "").startswith(("LATIN", "FULLWIDTH LATIN")):
                flags |= LATIN
        elif category == "Nd":
            flags |= DIGIT
        elif category[0] == "N":
            flags |= OTHER_NUMBER
        elif category in ("Mn", "Me"):
            flags |= MARK
        if char.isspace():
            flags |= BLANK
        table[code] = flags
    return table


def blocks(batches: Iterable[pa.RecordBatch], *texts: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows holding about ``limit`` bytes of the named string columns (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.zeros(batch.num_rows, np.int64)
        for name in texts:
            sizes += pc.binary_length(batch.column(name)).fill_null(0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = int(total[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def decode(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows and the row offsets among them; a null row is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    if not len(array):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(raw) or raw.max() < 0x80:
        return raw.astype(np.uint32), offsets
    starts = (raw & 0xC0) != 0x80
    try:
        text = raw.tobytes().decode("utf-8")
    except UnicodeDecodeError:  # bytes that are no UTF-8 become replacement characters
        return decode(pa.array([x.as_py().decode("utf-8", "replace") for x in array.cast(pa.binary())], pa.string()))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(starts, out=before[1:])
    return codes, before[offsets]


def encode(codes: np.ndarray, offsets: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """The reverse of ``decode``; rows where ``mask`` is true are null."""
    data = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
    widths = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    total = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(widths, out=total[1:])
    out = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(total[offsets].astype(np.int64).tobytes()), pa.py_buffer(data)).cast(pa.string())
    return out if mask is None or not mask.any() else pc.if_else(pa.array(mask), pa.scalar(None, pa.string()), out)


def runs(mask: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs; no run crosses an index in ``breaks``."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    if breaks is not None and len(inner := breaks[(breaks > 0) & (breaks < len(mask))]):
        first[inner] |= mask[inner]
        last[inner - 1] |= mask[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of the ranges [start, start + length), one range after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class CharMap:
    """One lookup table from a code point to none, one or several code points."""

    def __init__(self, table: dict[int, tuple[int, ...]]):
        self.to = np.arange(N_CODES, dtype=np.uint32)
        self.length = np.ones(N_CODES, np.uint8)
        longer: list[int] = []
        for code, out in table.items():
            self.length[code] = len(out)
            if len(out) == 1:
                self.to[code] = out[0]
            elif out:
                self.to[code] = len(longer)
                longer.extend(out)
        self.longer = np.array(longer, np.uint32)

    def apply(self, codes: np.ndarray, offsets: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Mapped codes, their row offsets, and the source index of each (None: as before); where ``only`` is false, codes stay."""
        out, lengths = self.to[codes], self.length[codes]
        if only is not None:
            out, lengths = np.where(only, out, codes), np.where(only, lengths, np.uint8(1))
        if (lengths == 1).all():
            return out, offsets, None
        ends = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        source = np.repeat(np.arange(len(codes)), lengths)
        result = out[source]
        if (several := np.flatnonzero(lengths > 1)).size:
            n = lengths[several].astype(np.int64)
            result[spread(ends[several], n)] = self.longer[spread(out[several].astype(np.int64), n)]
        return result, ends[offsets], source


_M1, _M2, _G1, _G2 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def hash_ranges(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty range: the sum of mixed (code point, place) pairs, so order counts."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = spread(starts, lengths)
    place = at - np.repeat(starts, lengths)
    mixed = mix(codes[at].astype(np.uint64) * _G1 + place.astype(np.uint64) * _G2)
    return mix(np.add.reduceat(mixed, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))


def row_of(offsets: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The row that holds each code-point index."""
    return np.searchsorted(offsets, index, "right") - 1
