"""Queries of the training-text operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.functions.tables import table
from quire.llm import encoding, languages, leaks, lookalikes, near_duplicates, repeated_lines, spam, splitting

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.found_fields(table(spark, d, "pages"))


def p1_normalised(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "pages").select("user_id", "doc_id", "number", "title", "text")
    return lookalikes.normalised(keys, "title", "text").distinct()


def p1_value_groups(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.value_groups(table(spark, d, "pages"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.found_places(table(spark, d, "pages"), table(spark, d, "manifest"))


def p2_cleaned_pages(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.cleaned_pages(table(spark, d, "pages"), table(spark, d, "manifest"))


def p2_frequent_lines(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.frequent_lines(table(spark, d, "pages"), table(spark, d, "manifest"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.found_labels(*(table(spark, d, x) for x in ("pages", "manifest", "extracted", "documents")))


def p3_page_languages(spark: SparkSession, d: str) -> DataFrame:
    return languages.page_languages(*(table(spark, d, x) for x in ("pages", "manifest", "documents")))


def p3_document_languages(spark: SparkSession, d: str) -> DataFrame:
    return languages.document_languages(*(table(spark, d, x) for x in ("pages", "manifest", "documents")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.found_pairs(table(spark, d, "chunks"), table(spark, d, "manifest"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.chunk_groups(table(spark, d, "chunks"))


def p4_subject_pairs(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.found_subjects(table(spark, d, "manifest"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.found_items(table(spark, d, "pages"), table(spark, d, "chunks"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(splitting.items(table(spark, d, "pages"), table(spark, d, "chunks")))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.token_ids(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.found_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_removal_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.removal_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.found_spam(table(spark, d, "documents"))


def p9_outliers(spark: SparkSession, d: str) -> DataFrame:
    return spam.flagged(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_normalised, p1_value_groups, p2_found, p2_cleaned_pages, p2_frequent_lines, p3_found, p3_page_languages, p3_document_languages, p4_found, p4_groups, p4_subject_pairs, p6_found, p6_pieces, p7_ids, p8_found, p8_removal_spans, p9_found, p9_outliers)}

SUBJECTS_SQL = "SELECT DISTINCT metadata.subject AS s FROM manifest WHERE metadata.subject IS NOT NULL"

LINKS_SQL = rf"""
        c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL),
        w AS (SELECT text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM (SELECT DISTINCT text FROM c)),
        k AS (SELECT text, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 30),
        e AS (SELECT text, len(s) AS n, unnest(s) AS t FROM k),
        p AS (SELECT a.text AS x, b.text AS y, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.t = b.t AND a.text <> b.text GROUP BY ALL),
        l AS (SELECT x, y FROM p WHERE c >= 0.6 * (na + nb - c))
"""
# fixed values: the forms in which ASCII signs are stored at double width
WIDE, NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
FOLDED = lambda c: f"regexp_extract_all(strip_accents(lower(translate(nfc_normalize({c}), '{WIDE}', '{NARROW.replace(chr(39), chr(39) * 2)}'))), '[\\p{{L}}\\p{{N}}]+')"

ORACLE_SQL: dict[str, str] = {
    "p4_groups": f"""
        WITH RECURSIVE {LINKS_SQL},
        r AS (SELECT text, text AS g FROM k UNION SELECT l.y, r.g FROM r JOIN l ON l.x = r.text),
        m AS (SELECT r.text, min(c.chunk_id) AS name FROM r JOIN c ON c.text = r.g GROUP BY r.text),
        d AS (SELECT x AS text, count(*) AS n FROM l GROUP BY x)
        SELECT chunk_id, min(name) AS "group", max(coalesce(d.n, 0)) AS n_links FROM c JOIN m USING (text) LEFT JOIN d USING (text) GROUP BY chunk_id
    """,
    "p8_found": f"""
        WITH d AS (SELECT doc_id, {FOLDED("text")} AS w FROM documents), i AS (SELECT item_id, {FOLDED("text")} AS w FROM eval_items),
        a AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
        b AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i WHERE len(w) >= 12)
        SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (g)
    """,
    "p4_found": rf"""
        WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL),
        w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM c),
        k AS (SELECT chunk_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 30),
        e AS (SELECT chunk_id, len(s) AS n, unnest(s) AS t FROM k),
        p AS (SELECT a.chunk_id AS x, b.chunk_id AS y, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.t = b.t AND a.chunk_id < b.chunk_id GROUP BY ALL),
        s AS ({SUBJECTS_SQL})
        SELECT 'chunk' AS kind, x AS key_a, y AS key_b FROM p WHERE c >= 0.6 * (na + nb - c)
        UNION ALL SELECT 'subject', a.s, b.s FROM s a JOIN s b ON a.s < b.s AND levenshtein(a.s, b.s) <= 3
    """,
    "p4_subject_pairs": """
        WITH s AS (SELECT DISTINCT metadata.subject AS s FROM manifest WHERE metadata.subject IS NOT NULL)
        SELECT a.s AS key_a, b.s AS key_b FROM s a JOIN s b ON a.s < b.s AND levenshtein(a.s, b.s) <= 3
    """,
    "p6_found": """
        SELECT DISTINCT kind, user_id, doc_id, page, part FROM (
            SELECT 'page' AS kind, user_id, doc_id, number AS page, -1 AS part, text FROM pages
            UNION ALL SELECT 'chunk', user_id, doc_id, page, part, text FROM chunks)
        WHERE length(text) > 4000 OR len(list_filter(regexp_split_to_array(text, '[\\s\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{85}\\x{0b}\\x{1c}-\\x{1f}]+'), lambda w: w <> '')) > 450
    """,
}
