"""Facts about pages and documents that the extract stage records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import text as T

DOC = ["user_id", "doc_id"]


def page_facts(pages: DataFrame, image_page_max_chars: int = 80) -> DataFrame:
    """(user_id, doc_id, number, char_count, word_count, mostly_image, empty, orientation, width, height): each page once.

    A null text counts no characters. Sizes are rounded to a tenth, ties to even.
    """
    n = F.length(F.coalesce("text", F.lit("")))
    rows = pages.select(
        *DOC, "number", n.alias("char_count"), T.word_count(F.coalesce("text", F.lit(""))).alias("word_count"), (n < image_page_max_chars).alias("mostly_image"), (n == 0).alias("empty"),
        F.when(F.col("width") > F.col("height"), "landscape").otherwise("portrait").alias("orientation"), F.bround("width", 1).alias("width"), F.bround("height", 1).alias("height"),
    )
    return rows.distinct()


def document_languages(pages: DataFrame) -> DataFrame:
    """(user_id, doc_id, languages): page labels, most frequent first, ties by first page; nulls left out. Pages count once."""
    labelled = pages.where("language is not null").groupBy(*DOC, "number").agg(F.max("language").alias("language"))
    counts = labelled.groupBy(*DOC, "language").agg(F.count("*").alias("n"), F.min("number").alias("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "language"))), lambda x: x["language"])
    return counts.groupBy(*DOC).agg(ordered.alias("languages"))


def weighted_median_size(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, body_size): the median font size, each span weighing its characters."""
    return spans.where(T.strip(F.col("text")) != "").groupBy(*keys).agg(F.percentile("size", F.lit(0.5), F.length("text").cast("bigint")).alias("body_size"))


def guess_titles(spans: DataFrame, keys: list[str], max_chars: int = 200) -> DataFrame:
    """(keys, title): the largest text in the top 30 % of a page, if at least 15 % larger than its body text.

    ``spans`` has the keys, ord, text, size, top and page_height. Parts within half a point of the
    largest size are joined in reading order. Pages without such a text have a null title.
    """
    solid = spans.where(T.strip(F.col("text")) != "")
    body = weighted_median_size(spans, keys)
    candidate = (F.col("top") < 0.3 * F.col("page_height")) & F.col("text").rlike(r"[\p{L}\p{N}]")
    joined = solid.withColumn("candidate", candidate).join(body, keys)
    largest = joined.withColumn("largest", F.max(F.when(F.col("candidate"), F.col("size"))).over(W.partitionBy(*keys)))
    part = F.when(F.col("candidate") & (F.col("size") >= F.col("largest") - 0.5) & (F.col("largest") >= F.col("body_size") * 1.15), F.struct("ord", T.strip(F.col("text")).alias("text")))
    joined_text = T.collapse(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), " "))
    titled = largest.groupBy(*keys).agg(joined_text.alias("t"))
    return titled.select(*keys, F.when(F.col("t") != "", F.substring("t", 1, max_chars)).alias("title"))


def content_id(content: Column) -> Column:
    """SHA-256 of the bytes, in hexadecimal."""
    return F.sha2(content, 256)
