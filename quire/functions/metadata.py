"""Labels from folder and file names, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The kinds of document a folder may name.
DOC_TYPES = ("theory", "labs", "exercises", "exams")
#: The forms of names and years, the signs between two years, and the range of two-digit years written together.
SLUG = r"^[a-z0-9_]+$"
ACADEMIC_YEAR = r"^\d{4}-\d{2}$"
YEAR_SIGNS, FIRST_SHORT, LAST_SHORT = "-_/", 10, 50
OUTSIDE = "no label: the file lies outside a subject folder and a document type folder"


def two(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def is_slug(c: Column) -> Column:
    return c.rlike(SLUG)


def is_academic_year(c: Column) -> Column:
    """yyyy-yy with consecutive years."""
    return c.rlike(ACADEMIC_YEAR) & ((F.substring(c, 1, 4).cast("int") + 1) % 100 == F.substring(c, 6, 2).cast("int"))


def year_from_filename(name: Column) -> Column:
    """The academic year a file name states: 20yy and the next year with one sign between, else two consecutive
    two-digit years from 10 to 50 written together; null where neither holds.

    The name is taken apart into its runs of digits. Whatever is no digit and no sign becomes two marks,
    so two neighbouring runs have exactly one sign between them.
    """
    runs = F.split(F.regexp_replace(name, f"[^0-9{YEAR_SIGNS.replace('-', '')}-]", ".."), "[^0-9]")
    century = lambda r: (F.length(r) == 4) & F.startswith(r, F.lit("20"))
    pairs = F.zip_with(runs, F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    first_of = lambda a: F.try_element_at(a, F.lit(1))
    stated = first_of(F.filter(pairs, lambda p: century(p["a"]) & ((F.length(p["b"]) == 2) | century(p["b"]))))
    start, end = stated["a"].cast("int"), stated["b"].cast("int") % 100
    with_sign = F.when((start + 1) % 100 == end, F.concat(start.cast("string"), F.lit("-"), two(end)))
    first, second = lambda r: F.substring(r, 1, 2).cast("int"), lambda r: F.substring(r, 3, 2).cast("int")
    short = first_of(F.filter(runs, lambda r: (F.length(r) == 4) & first(r).between(FIRST_SHORT, LAST_SHORT) & ((first(r) + 1) % 100 == second(r))))
    return F.coalesce(with_sign, F.concat(F.lit("20"), F.substring(short, 1, 2), F.lit("-"), F.substring(short, 3, 2)))


def folder_hint(rel_path: Column) -> tuple[Column, Column, Column]:
    """Subject and kind of document that the folders name (null above two folders), and the file's name."""
    parts = F.split(rel_path, "/")
    deep = F.size(parts) >= 3
    return F.when(deep, parts[0]), F.when(deep, parts[1]), F.element_at(parts, -1)


def label_error(subject: Column, known: Column, doc_type: Column, labelled: bool) -> Column:
    """Why the folders cannot label a file; null where they do, or where nothing asks for a label."""
    unlabelled = F.lit(OUTSIDE) if labelled else F.lit(None).cast("string")
    return (
        F.when(subject.isNull(), unlabelled)
        .when(known.isNull(), F.concat(F.lit("unknown subject folder "), subject))
        .when(~doc_type.isin(*DOC_TYPES), F.concat(F.lit("unknown document type folder "), doc_type))
    )
