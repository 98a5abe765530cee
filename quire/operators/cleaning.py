"""Lines that repeat over the pages of one document, and bare page numbers, taken out of page texts.

A line may be boilerplate when its stripped length is 1 to ``max_chars`` and it holds a letter. It
is boilerplate when such lines with its key (blanks collapsed, lower case) stand on at least
max(min_pages, ceil(min_share * pages)) pages of the document. Every line with a boilerplate key goes,
whatever its own length. A number of one to four digits goes when it is the first or last line
with content and equals the page's place, or one or two less.

Null texts count as empty pages. Repeated rows of a page count once. One shuffle, by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quire.functions import text as T

#: Fixed value: the label under which removed page numbers are counted.
PAGE_NUMBER = "(page number)"
DOC = ["user_id", "doc_id"]


def distinct_pages(pages: DataFrame, *columns: str) -> DataFrame:
    """Each page once, with its place in the document and the document's number of pages; hash partitioned by document."""
    chosen = pages.select(*DOC, "number", "text", *columns).repartition(*DOC)
    each = chosen.groupBy(*DOC, "number").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), *columns)).alias("s")).select(*DOC, "number", "s.*")
    document = W.partitionBy(*DOC)
    return each.withColumn("place", F.row_number().over(document.orderBy("number"))).withColumn("n_pages", F.count("*").over(document))


def page_lines(pages: DataFrame, max_chars: int, *columns: str) -> DataFrame:
    """One row for each line: (user_id, doc_id, number, place, n_pages, first, last, i, line, stripped, key, can).

    ``first`` and ``last`` are the places of the page's first and last line with content. A page without
    lines keeps one row, whose line is null.
    """
    text = F.col("text")
    lead = F.regexp_extract(text, f"^{T.BLANK}*", 0)
    first, last = F.size(T.lines(F.concat(lead, F.lit("x")))) - 1, F.size(T.lines(T.strip(F.concat(F.lit("x"), text)))) - 1
    # the page's own columns are made below the generator, else they would be made again for each line
    whole = pages.select(*DOC, "number", "place", "n_pages", *columns, first.alias("first"), last.alias("last"), T.lines(text).alias("_lines"))
    split = whole.select(*DOC, "number", "place", "n_pages", *columns, "first", "last", F.posexplode_outer("_lines").alias("i", "line"))
    stripped = split.withColumn("stripped", T.strip(F.col("line")))
    can = F.length("stripped").between(1, max_chars) & F.col("stripped").rlike(r"\p{L}")
    return stripped.withColumn("key", T.line_key(F.col("stripped"))).withColumn("can", can)


def with_page_counts(lines: DataFrame, min_share: float, min_pages: int) -> DataFrame:
    """The lines with ``on_pages`` (pages of the document on which such a line with this key stands) and ``least`` (the threshold).

    Two windows over one order of a document's lines: no join, and no shuffle beyond the one by document.
    """
    once = F.row_number().over(W.partitionBy(*DOC, "key", "number").orderBy(F.desc("can"))) == 1
    counted = lines.withColumn("_first", F.when(once & F.col("can"), 1).otherwise(0))
    least = F.greatest(F.lit(min_pages), F.ceil(F.lit(min_share) * F.col("n_pages")))
    return counted.withColumn("on_pages", F.sum("_first").over(W.partitionBy(*DOC, "key"))).withColumn("least", least).drop("_first")


def boilerplate_keys(pages: DataFrame, min_share: float = 0.5, min_pages: int = 3, max_chars: int = 100) -> DataFrame:
    """(user_id, doc_id, key, n_pages): the keys over the document's threshold."""
    lines = with_page_counts(page_lines(distinct_pages(pages), max_chars), min_share, min_pages)
    return lines.where("on_pages >= least").groupBy(*DOC, "key").agg(F.max("on_pages").alias("n_pages"))


def judged_lines(pages: DataFrame, min_share: float = 0.5, min_pages: int = 3, max_chars: int = 100, columns: tuple[str, ...] = ()) -> DataFrame:
    """The lines with ``is_boilerplate`` and ``is_number``."""
    lines = with_page_counts(page_lines(distinct_pages(pages, *columns), max_chars, *columns), min_share, min_pages)
    edge = (F.col("i") == F.col("first")) | (F.col("i") == F.col("last"))
    value = F.when(F.col("stripped").rlike(r"^\d{1,4}$"), F.col("stripped").cast("int"))
    boilerplate = F.coalesce((F.col("on_pages") >= F.col("least")) & (F.col("stripped") != ""), F.lit(False))
    number = F.coalesce(edge & (value >= 1) & (F.col("place") - value).between(0, 2), F.lit(False))
    return lines.withColumn("is_boilerplate", boilerplate).withColumn("is_number", number & ~boilerplate)


def cleaned_pages(pages: DataFrame, min_share: float = 0.5, min_pages: int = 3, max_chars: int = 100, columns: tuple[str, ...] = ()) -> DataFrame:
    """(user_id, doc_id, number, text[, columns]): page texts without boilerplate and page numbers; every page stays."""
    judged = judged_lines(pages, min_share, min_pages, max_chars, columns)
    kept = F.when(~F.col("is_boilerplate") & ~F.col("is_number") & F.col("line").isNotNull(), F.struct("i", "line"))
    rebuilt = F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["line"]), "\n")
    return judged.groupBy(*DOC, "number").agg(T.strip(T.squeeze_blank_lines(rebuilt)).alias("text"), *[F.max(c).alias(c) for c in columns])


def removed_lines(pages: DataFrame, min_share: float = 0.5, min_pages: int = 3, max_chars: int = 100) -> DataFrame:
    """(user_id, doc_id, text, n_removed): what cleaning took out, labelled by the first spelling."""
    judged = judged_lines(pages, min_share, min_pages, max_chars).where("is_boilerplate or is_number")
    key = F.when(F.col("is_number"), F.lit(None)).otherwise(F.col("key"))
    label = F.coalesce(F.min_by(F.when(~F.col("is_number"), T.collapse(F.col("stripped"))), F.struct("place", "i")), F.lit(PAGE_NUMBER))
    return judged.groupBy(*DOC, key.alias("k")).agg(label.alias("text"), F.count("*").alias("n_removed")).drop("k")


def boilerplate_audit(removed: DataFrame) -> DataFrame:
    """(text, n_documents): in how many documents each removed line was removed."""
    return removed.select(*DOC, "text").distinct().groupBy("text").agg(F.count("*").alias("n_documents"))
