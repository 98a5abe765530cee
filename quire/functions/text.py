"""Text helpers as column expressions; the patterns are shared with the SQL twins."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Every blank that str.split() splits at, spelt out because \s differs between regex engines.
BLANK = r"[\t\n\x{0b}\x{0c}\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Every terminator that str.splitlines() splits at.
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"


#: The same blanks as characters.
BLANKS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    """Blank runs to one space, ends stripped."""
    return F.regexp_replace(F.trim(F.translate(c, BLANKS, " " * len(BLANKS))), " {2,}", " ")


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{BLANK}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    plain = F.trim(F.translate(c, BLANKS, " " * len(BLANKS)))
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, " +"))).cast("int")


def lines(c: Column) -> Column:
    """The lines of a text without their terminators; a final terminator begins no line."""
    parts = F.split(c, LINE_END, -1)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def line_key(c: Column) -> Column:
    return F.lower(collapse(c))


def letter_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\P{L}", ""))


def squeeze_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


@F.pandas_udf(StringType())
def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFC; Spark has no built-in for it. ASCII texts are passed as they are."""
    for texts in batches:
        yield texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normalise_text(c: Column) -> Column:
    """NFC, line ends stripped, three or more line feeds to two, ends stripped."""
    plain = F.when(c.rlike(r"[^\x{00}-\x{7f}]"), nfc(c)).otherwise(c)
    plain = F.regexp_replace(plain, LINE_END, "\n")
    plain = F.regexp_replace(plain, rf"(?m){BLANK.replace(chr(92) + 'n', '')}+$", "")
    return strip(squeeze_blank_lines(plain))


def snippet(c: Column, length: int = 120) -> Column:
    return F.substring(collapse(c), 1, length)
