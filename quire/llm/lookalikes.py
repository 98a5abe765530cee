"""Problem 1: text that looks the same but is stored with other characters.

``normalise`` brings a block of texts to one form: characters nobody sees are
removed, every blank but tab and line feed becomes a space, width, ligature
and presentation forms become their letters, a letter and its marks in any order become the
composed letter (jamo their syllable), and letters of other alphabets drawn like Latin ones become
Latin where they stand in a word with Latin letters.
Kept as they are: words wholly in another alphabet, single mathematical letters, super- and
subscripts, ordinal signs, bullets, dashes and quotation marks. Null stays null and empty stays
empty; a text may become empty when it held only invisible characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quire.llm.codepoints import LATIN, LETTER, MARK, N_CODES, CharMap, blocks, classes, decode, encode, row_of, runs, spread, tabulated

# Letters of other alphabets and the Latin letters they are drawn like.
LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "ϒ": "Y", "Ϳ": "J",
    "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Һ": "H", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "к": "k", "о": "o", "п": "n", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "ï", "ј": "j", "ѵ": "v", "һ": "h", "ү": "y", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѐ": "è", "ё": "ë",
    "Տ": "S", "Օ": "O", "Ս": "U", "Լ": "L", "ո": "n", "ս": "u", "օ": "o", "հ": "h", "ց": "g", "զ": "q", "ա": "w", "յ": "j", "ք": "p", "լ": "l",
    "Ь": "b", "ь": "b", "г": "r",
    "ɴ": "N", "ʀ": "R", "ʙ": "B", "ʜ": "H", "ʟ": "L", "ɢ": "G", "ᴀ": "A", "ᴅ": "D", "ᴇ": "E", "ᴊ": "J", "ᴋ": "K", "ᴍ": "M", "ᴘ": "P", "ᴛ": "T", "ᴜ": "U", "ꜰ": "F",
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ɪ": "i", "ʏ": "y", "ʋ": "v", "ı": "i", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮤ": "W", "Ꮓ": "Z",
    "Ꮐ": "G", "Ꮢ": "R", "Ꮃ": "W", "Ꭹ": "Y", "Ꮷ": "d", "Ꭵ": "i", "Ꮟ": "b", "Ꮒ": "h", "ꮓ": "z", "ꮩ": "v", "ꮪ": "s", "ꮃ": "w", "ꮯ": "c", "ꭵ": "i", "ꮁ": "r",
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
}
#: Where the Hangul jamo and syllables begin, and how many medials and finals (with none) there are.
HANGUL_L, HANGUL_V, HANGUL_T, HANGUL_S, N_L, N_V, N_T = 0x1100, 0x1161, 0x11A7, 0xAC00, 19, 21, 28
#: Fillers that are drawn as nothing though they are no format characters.
INVISIBLE = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
#: Kinds of compatibility form that are drawn like the characters they stand for.
SAME_DRAWING = ("wide", "narrow", "compat", "noBreak", "initial", "medial", "final", "isolated")
FLAG_ALWAYS, FLAG_MATHS, FLAG_JOINER = 1, 2, 4


@lru_cache(1)
def tables() -> tuple[CharMap, np.ndarray, np.ndarray]:
    """The map that needs no context, the flags of the code points it touches, and the look-alike table (0: none)."""
    table: dict[int, tuple[int, ...]] = {}
    flags = np.zeros(N_CODES, np.uint8)
    for code in tabulated():
        char = chr(code)
        category, decomposition = unicodedata.category(char), unicodedata.decomposition(char)
        kind = decomposition[1 : decomposition.index(">")] if decomposition.startswith("<") else ""
        out: tuple[int, ...] | None = None
        flag = FLAG_ALWAYS
        if char in "\t\n ":
            continue
        if category == "Zs" or char in "\x0b\x0c\r\x85\u2028\u2029":
            out = (32,)
        elif category in ("Cf", "Cc") or code in INVISIBLE or 0xFE00 <= code <= 0xFE0F or 0x180B <= code <= 0x180F or 0xE0000 <= code <= 0xE01EF:
            out = ()
            if code in (0x200C, 0x200D):
                flag |= FLAG_JOINER
        elif code == 0x2011:
            out = (0x2D,)
        elif kind in SAME_DRAWING:
            plain = unicodedata.normalize("NFKC", char)
            wide = kind in ("wide", "narrow")
            lettered = category[0] == "L" or category == "Nl"
            if plain != char and (wide or lettered and all(unicodedata.category(c)[0] in "LM" or c == "·" for c in plain)) and category != "Lm":
                out = tuple(map(ord, plain))
        elif kind == "font" and (0x1D400 <= code < 0x1D800 or 0x2100 <= code < 0x2150 and unicodedata.normalize("NFKC", char).isalpha()):
            # some places of the mathematical alphabets are holes: their letters stand among the letterlike symbols
            out, flag = tuple(map(ord, unicodedata.normalize("NFKC", char))), FLAG_MATHS
        elif not kind and decomposition and (plain := unicodedata.normalize("NFC", char)) != char:
            out = tuple(map(ord, plain))
        if out is not None:
            table[code] = out
            flags[code] = flag
    alike = np.zeros(N_CODES, np.uint32)
    for char, latin in LOOKALIKES.items():
        alike[ord(char)] = ord(latin)
    return CharMap(table), flags, alike


@lru_cache(1)
def compositions() -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (base << 21 | mark) and the composed letters."""
    pairs = {}
    for code in tabulated():
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(code)) == chr(code):
            pairs[int(parts[0], 16) << 21 | int(parts[1], 16)] = code
    keys = np.array(sorted(pairs), np.int64)
    return keys, np.array([pairs[int(k)] for k in keys], np.uint32)


@lru_cache(1)
def combining() -> tuple[np.ndarray, np.ndarray, CharMap]:
    """Combining class by code point, what may join the character before it, and the letters that have marks in them, taken apart."""
    order = np.zeros(N_CODES, np.uint8)
    apart: dict[int, tuple[int, ...]] = {}
    for code in tabulated():
        char = chr(code)
        order[code] = unicodedata.combining(char)
        if len(plain := unicodedata.normalize("NFD", char)) > 1 and not unicodedata.combining(char) and unicodedata.normalize("NFC", char) == char:
            apart[code] = tuple(map(ord, plain))
    joins = order > 0
    joins[(compositions()[0] & 0x1FFFFF).astype(np.int64)] = True
    joins[HANGUL_V : HANGUL_V + N_V] = joins[HANGUL_T + 1 : HANGUL_T + N_T] = True
    return order, joins, CharMap(apart)


def _paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The letter that two code points compose to; 0 where they do not."""
    keys, composed = compositions()
    a, b = first.astype(np.int64), second.astype(np.int64)
    at = np.minimum(np.searchsorted(keys, a << 21 | b), len(keys) - 1)
    out = np.where(keys[at] == (a << 21 | b), composed[at], 0).astype(np.int64)
    lead, vowel, syllable, final = a - HANGUL_L, b - HANGUL_V, a - HANGUL_S, b - HANGUL_T
    out = np.where((lead >= 0) & (lead < N_L) & (vowel >= 0) & (vowel < N_V), HANGUL_S + (lead * N_V + vowel) * N_T, out)
    return np.where((syllable >= 0) & (syllable < N_L * N_V * N_T) & (syllable % N_T == 0) & (final > 0) & (final < N_T), a + final, out)


def _compose(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with marks in canonical order and composed, and the rows that changed by it; only rows that hold any are worked on."""
    rows = np.unique(row_of(offsets, np.flatnonzero(combining()[1][codes])))
    size = np.diff(offsets)
    some, some_offsets, changed = _composed_rows(codes[spread(offsets[rows], size[rows])], np.concatenate([[0], np.cumsum(size[rows])]))
    if not len(changed):
        return codes, offsets, changed
    new_size = size.copy()
    new_size[rows] = np.diff(some_offsets)
    new_offsets = np.concatenate([[0], np.cumsum(new_size)])
    out = np.empty(int(new_offsets[-1]), codes.dtype)
    rest = np.setdiff1d(np.arange(len(size)), rows)
    out[spread(new_offsets[rest], size[rest])] = codes[spread(offsets[rest], size[rest])]
    out[spread(new_offsets[rows], new_size[rows])] = some
    return out, new_offsets, rows[changed]


def _composed_rows(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters with the marks that follow in canonical order and composed; also the rows that changed by it.

    Letters before a mark are taken apart, marks are sorted by class inside their run, and in each
    round the first mark of a run that nothing of its class blocks and that composes goes into its letter.
    """
    order, joins, apart = combining()
    old_codes, old_offsets = codes, offsets

    def row_starts() -> np.ndarray:
        out = np.zeros(len(codes) + 1, bool)
        out[offsets] = True
        return out[:-1]

    lead = row_starts()
    before = np.zeros(len(codes), bool)
    before[:-1] = (order[codes[1:]] > 0) & ~lead[1:]
    codes, offsets, _ = apart.apply(codes, offsets, before)
    rank, lead = order[codes], row_starts()
    marks = np.flatnonzero(rank)
    run = np.cumsum((rank == 0) | lead)
    codes = codes.copy()
    codes[marks] = codes[marks[np.lexsort((rank[marks], run[marks]))]]
    while True:
        rank, lead, index = order[codes], row_starts(), np.arange(len(codes))
        base = np.maximum.accumulate(np.where((rank == 0) | lead, index, 0))
        at = np.flatnonzero(joins[codes] & ~lead)
        free = np.where(rank[at] > 0, (base[at] == at - 1) | (rank[at - 1] < rank[at]), rank[at - 1] == 0)
        at = at[free]
        into = np.where(rank[at] > 0, base[at], at - 1)
        at, into = at[rank[into] == 0], into[rank[into] == 0]
        made = _paired(codes[into], codes[at])
        at, into, made = at[made > 0], into[made > 0], made[made > 0]
        into, first = np.unique(into, return_index=True)
        at, made = at[first], made[first]
        keep = ~np.isin(into, at)  # what is itself about to go waits for the next round
        if not len(at):
            break
        at, into, made = at[keep], into[keep], made[keep]
        codes[into] = made
        left = np.ones(len(codes), bool)
        left[at] = False
        place = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(left, out=place[1:])
        codes, offsets = codes[left], place[offsets]
    size, old_size = np.diff(offsets), np.diff(old_offsets)
    changed = size != old_size
    same = np.flatnonzero(~changed & (size > 0))
    differs = codes[spread(offsets[same], size[same])] != old_codes[spread(old_offsets[same], size[same])]
    changed[np.repeat(same, size[same])[differs]] = True
    return codes, offsets, np.flatnonzero(changed)


def normalise(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one form, their offsets, and for each row whether it held a disguised character."""
    n = len(offsets) - 1
    found = np.zeros(n, bool)
    if not len(codes) or codes.max() < 0x80 and not ((codes < 32) & (codes != 9) & (codes != 10)).any() and not (codes == 127).any():
        return codes, offsets, found
    mapping, flags, alike = tables()
    kinds = classes()
    if (returns := np.flatnonzero(codes[:-1] == 13)).size and (returns := returns[(codes[returns + 1] == 10) & ~np.isin(returns + 1, offsets)]).size:
        codes = codes.copy()
        codes[returns] = 0x200B  # before a line feed it is drawn as nothing
    here = flags[codes]
    if (maths := np.flatnonzero(here == FLAG_MATHS)).size:
        # a mathematical letter that stands alone is notation: keep it
        letters = ((kinds[codes] & LETTER) > 0) | (here == FLAG_MATHS)
        a, b = runs(letters, offsets)
        alone = maths[(b - a)[np.searchsorted(a, maths, "right") - 1] == 1]
        here = here.copy()
        here[alone] = 0
    if (joiners := np.flatnonzero(here & FLAG_JOINER)).size:
        # joiners shape words of alphabets other than the Latin one: keep them there
        inner = joiners[(joiners > 0) & (joiners < len(codes) - 1)]
        foreign = ((kinds[codes[inner - 1]] & (LETTER | LATIN)) == LETTER) & ((kinds[codes[inner + 1]] & (LETTER | LATIN)) == LETTER) & (alike[codes[inner - 1]] == 0) & (alike[codes[inner + 1]] == 0)
        here = here.copy()
        here[inner[foreign]] = 0
    if here.any():
        rows = row_of(offsets, np.flatnonzero(here))
        found[rows] = True
        kept = np.flatnonzero((here == 0) & (flags[codes] > 0))
        guarded = codes
        if kept.size:  # kept ones pass the map as private-use stand-ins
            guarded = codes.copy()
            guarded[kept] = 0x10FFFE
        mapped, ends, source = mapping.apply(guarded, offsets)
        if kept.size:
            mapped = mapped.copy()
            back = np.flatnonzero(mapped == 0x10FFFE)
            mapped[back] = codes[source[back] if source is not None else back]
        codes, offsets = mapped, ends
    kind = kinds[codes]
    if combining()[1][codes].any():
        codes, offsets, rows = _compose(codes, offsets)
        found[rows] = True
        kind = kinds[codes]
    latin = alike[codes]
    if (at := np.flatnonzero(latin)).size:
        a, b = runs((kind & (LETTER | MARK)) > 0, offsets)
        word = np.searchsorted(a, at, "right") - 1
        plain = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(((kind & LATIN) > 0) & (latin == 0), out=plain[1:])
        foreign = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(((kind & (LETTER | LATIN)) == LETTER) & (latin == 0), out=foreign[1:])
        n_plain, n_foreign = plain[b[word]] - plain[a[word]], foreign[b[word]] - foreign[a[word]]
        at = at[(n_plain > 0) & (n_foreign <= n_plain)]
        if at.size:
            codes = codes.copy()
            codes[at] = latin[at]
            found[row_of(offsets, at)] = True
            # a look-alike base may now compose with the mark after it
            if combining()[1][codes].any():
                codes, offsets, _ = _compose(codes, offsets)
    return codes, offsets, found


def found_fields(pages: DataFrame) -> DataFrame:
    """(user_id, doc_id, number, field): the page titles and texts that hold a disguised character, each once."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "title", "text"):
            for field in ("title", "text"):
                _, _, found = normalise(*decode(block.column(field)))
                if found.any():
                    hit = block.select(["user_id", "doc_id", "number"]).filter(pa.array(found))
                    yield hit.append_column("field", pa.array([field] * hit.num_rows))

    keys = pages.select("user_id", "doc_id", "number", "title", "text")
    return keys.mapInArrow(work, "user_id string, doc_id string, number int, field string").distinct()


def normalised(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the named string columns in one form; every other column passes as it is."""
    names = list(columns)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, *names):
            for name in names:
                array = block.column(name)
                codes, offsets, found = normalise(*decode(array))
                if found.any():
                    at = block.schema.get_field_index(name)
                    block = block.set_column(at, block.schema.field(at), encode(codes, offsets, pc.is_null(array).to_numpy(zero_copy_only=False)))
            yield block

    return df.mapInArrow(work, df.schema)


def value_groups(pages: DataFrame) -> DataFrame:
    """(field, value_hash, n_spellings, n_rows): normalised values that the pages store in more than one spelling.

    Counted over all rows; nulls are no value.
    """
    raw = pages.select(F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("stored")), F.struct(F.lit("text").alias("field"), F.col("text").alias("stored")))).alias("x")).select("x.*").where("stored is not null")
    pairs = normalised(raw.withColumn("value", F.col("stored")), "value")
    hashed = pairs.select("field", F.xxhash64("value").alias("value_hash"), F.xxhash64("stored").alias("spelling"))
    counted = hashed.groupBy("field", "value_hash", "spelling").agg(F.count("*").alias("n"))
    return counted.groupBy("field", "value_hash").agg(F.count("*").alias("n_spellings"), F.sum("n").alias("n_rows")).where("n_spellings > 1")
