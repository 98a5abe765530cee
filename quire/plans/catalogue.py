"""The registered queries of the engine's core, each over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions import metadata as M, text as T
from quire.functions.language import TrigramModel, trigram_counts
from quire.functions.tables import table
from quire.operators import cells, chunking, cleaning, extracting, incremental, manifest as MF, registering, vectors
from quire.operators.embedding import HashEmbedder, embedding_text
from quire.sources.loaders import default_registry, extractor_version
from quire.streaming.folder import event_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = ["user_id", "doc_id"]

# Patterns of the SQL twins, the same text as in the column expressions.
B, LE = T.BLANK, T.LINE_END
COLLAPSE = lambda c: f"trim(regexp_replace({c}, '{B}+', ' ', 'g'))"
STRIP = lambda c: f"regexp_replace(regexp_replace({c}, '^{B}+', ''), '{B}+$', '')"
WORDS = lambda c: f"len(list_filter(regexp_split_to_array({c}, '{B}+'), lambda w: w <> ''))"
MANIFEST_SQL = "(SELECT * FROM manifest WHERE user_id IS NOT NULL AND doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, doc_id ORDER BY updated_at DESC, rel_path DESC) = 1)"
PAGES_SQL = "(SELECT user_id, doc_id, number, coalesce(max(text), '') AS text, row_number() OVER (PARTITION BY user_id, doc_id ORDER BY number) AS place, count(*) OVER (PARTITION BY user_id, doc_id) AS n_pages FROM pages GROUP BY user_id, doc_id, number)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# problem 5


@query("""
    WITH d AS (SELECT DISTINCT user_id, doc_id FROM manifest WHERE user_id IS NOT NULL AND doc_id IS NOT NULL),
    f AS (SELECT user_id, doc_id, stage, version, completed_at FROM stages WHERE output IS NOT NULL AND completed_at IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY user_id, doc_id, stage ORDER BY completed_at DESC, version DESC) = 1),
    e AS (SELECT * FROM f WHERE stage = 'extract'), c AS (SELECT * FROM f WHERE stage = 'chunk'),
    w AS (SELECT DISTINCT user_id, doc_id, chunker FROM chunked),
    v AS (SELECT max(version) AS v FROM current_versions WHERE stage = 'chunk')
    SELECT d.user_id, d.doc_id FROM d JOIN e USING (user_id, doc_id) LEFT JOIN c USING (user_id, doc_id)
    LEFT JOIN w ON w.user_id = d.user_id AND w.doc_id = d.doc_id AND w.chunker = c.version
    WHERE NOT coalesce(c.completed_at >= e.completed_at AND c.version = (SELECT v FROM v) || ':' || e.version AND w.chunker IS NOT NULL, false)
""")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents due for the next chunk run, from a result kept by partitions and brought up to date."""
    state = incremental.ChangedPartitions(spark, incremental.state_folder(spark, "p5", d), KEY)
    state.refresh(incremental.documents_to_chunk, {t: table(spark, d, t) for t in ("manifest", "stages", "chunked")}, {"current_versions": table(spark, d, "current_versions")})
    return state.read().select(*KEY)


# scans, manifest and registering


@query("SELECT doc_id, sha256(text) AS content_id FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", extracting.content_id(F.encode("text", "UTF-8")).alias("content_id"))


@query(f"SELECT user_id, doc_id, source, rel_path, size_bytes, metadata.subject AS subject, metadata.doc_type AS doc_type, metadata.academic_year AS academic_year, metadata.professor AS professor, epoch_us(registered_at) AS registered_us, epoch_us(updated_at) AS updated_us FROM {MANIFEST_SQL}")
def current_manifest(spark: SparkSession, d: str) -> DataFrame:
    labels = [F.col(f"metadata.{c}").alias(c) for c in ("subject", "doc_type", "academic_year", "professor")]
    return MF.current(table(spark, d, "manifest")).select(*KEY, "source", "rel_path", "size_bytes", *labels, F.unix_micros("registered_at").alias("registered_us"), F.unix_micros("updated_at").alias("updated_us"))


@query("""
    SELECT user_id, doc_id, stage, version, output, epoch_us(completed_at) AS completed_us FROM stages
    WHERE output IS NOT NULL AND completed_at IS NOT NULL AND user_id IS NOT NULL AND doc_id IS NOT NULL AND stage IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY user_id, doc_id, stage ORDER BY completed_at DESC, version DESC, output DESC) = 1
""")
def current_stages(spark: SparkSession, d: str) -> DataFrame:
    return MF.current_stages(table(spark, d, "stages")).select(*KEY, "stage", "version", "output", F.unix_micros("completed_at").alias("completed_us"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """A scan derived from the manifest: every distinct row is a file; extensions in capitals are unreadable ones."""
    error = F.when(F.col("rel_path").like("%.PDF"), F.lit("unreadable"))
    return table(spark, d, "manifest").select("user_id", "source", "rel_path", "doc_id", "size_bytes", "metadata", error.alias("error")).distinct()


def _older(spark: SparkSession, d: str) -> DataFrame:
    """An older manifest: some records not yet there, some at another place, some from another source."""
    digit = F.substring("doc_id", 1, 1)
    rows = MF.current(table(spark, d, "manifest")).where(digit != "0")
    path = F.when(digit == "1", F.concat(F.lit("old/"), "rel_path")).otherwise(F.col("rel_path"))
    return rows.withColumn("rel_path", path).withColumn("source", F.when(digit == "2", F.lit("testing")).otherwise(F.col("source")))


REGISTER_SQL = f"""
    WITH files AS (SELECT DISTINCT user_id, source, rel_path, doc_id, metadata, CASE WHEN rel_path LIKE '%.PDF' THEN 'unreadable' END AS error FROM manifest),
    good AS (SELECT *, row_number() OVER w AS copy, first(rel_path) OVER w AS kept_path FROM files WHERE error IS NULL
             WINDOW w AS (PARTITION BY user_id, source, doc_id ORDER BY string_split(rel_path, '/'))),
    old AS (SELECT user_id, doc_id, CASE WHEN doc_id[1] = '2' THEN 'testing' ELSE source END AS old_source,
                   CASE WHEN doc_id[1] = '1' THEN 'old/' || rel_path ELSE rel_path END AS old_path, metadata AS old_metadata FROM {MANIFEST_SQL} WHERE doc_id[1] <> '0'),
    judged AS (SELECT g.user_id, g.source, g.doc_id, g.rel_path, o.old_source, o.old_path,
        CASE WHEN o.old_path IS NULL THEN 'new'
             WHEN o.old_source <> g.source AND EXISTS (SELECT 1 FROM good t WHERE t.user_id = g.user_id AND t.source = o.old_source AND t.rel_path = o.old_path) THEN 'duplicate'
             WHEN o.old_path = g.rel_path AND o.old_source = g.source AND o.old_metadata IS NOT DISTINCT FROM g.metadata THEN 'unchanged' ELSE 'moved' END AS status
        FROM good g LEFT JOIN old o USING (user_id, doc_id) WHERE g.copy = 1),
    statuses AS (
    SELECT user_id, source, doc_id, rel_path, status, CASE status WHEN 'duplicate' THEN old_source || '/' || old_path WHEN 'moved' THEN old_path END AS detail FROM judged
    UNION ALL SELECT user_id, source, doc_id, rel_path, 'duplicate', kept_path FROM good WHERE copy > 1
    UNION ALL SELECT user_id, source, doc_id, rel_path, 'error', error FROM files WHERE error IS NOT NULL
    UNION ALL SELECT user_id, old_source, doc_id, old_path, 'missing', NULL FROM old o WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.copy = 1 AND g.user_id = o.user_id AND g.source = o.old_source AND g.doc_id = o.doc_id))
"""


@query(REGISTER_SQL + "SELECT * FROM statuses")
def register_statuses(spark: SparkSession, d: str) -> DataFrame:
    return registering.register(_files(spark, d), _older(spark, d))


@query(REGISTER_SQL + "SELECT source, status, count(*) AS n FROM statuses GROUP BY ALL")
def register_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return registering.status_counts(register_statuses(spark, d))


@query(REGISTER_SQL + "SELECT user_id, source, doc_id, rel_path FROM statuses WHERE status = 'missing'")
def missing_documents(spark: SparkSession, d: str) -> DataFrame:
    return register_statuses(spark, d).where("status = 'missing'").select("user_id", "source", "doc_id", "rel_path")


@query(REGISTER_SQL + f"""
    , changed AS (SELECT DISTINCT ON (f.user_id, f.doc_id) f.* FROM (SELECT DISTINCT user_id, source, rel_path, doc_id, size_bytes, metadata FROM manifest) f JOIN statuses s USING (user_id, source, doc_id, rel_path) WHERE s.status IN ('new', 'moved'))
    SELECT user_id, doc_id FROM old WHERE NOT EXISTS (SELECT 1 FROM changed c WHERE c.user_id = old.user_id AND c.doc_id = old.doc_id) UNION ALL SELECT user_id, doc_id FROM changed
""")
def manifest_after_register(spark: SparkSession, d: str) -> DataFrame:
    files, old = _files(spark, d), _older(spark, d)
    return registering.apply_statuses(old, files, registering.register(files, old), F.to_timestamp(F.lit("2026-01-01"))).select(*KEY)


@query("SELECT user_id, source, doc_id, rel_path, row_number() OVER w AS copy, first(rel_path) OVER w AS kept_path FROM (SELECT DISTINCT user_id, source, doc_id, rel_path FROM manifest) WINDOW w AS (PARTITION BY user_id, source, doc_id ORDER BY string_split(rel_path, '/'))")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return registering.keep_first(table(spark, d, "manifest").select("user_id", "source", "doc_id", "rel_path").distinct())


@query(f"""
    SELECT source, coalesce(metadata.subject, '(unorganised)') AS subject, coalesce(metadata.doc_type, '(unorganised)') AS doc_type, count(*) AS n
    FROM {MANIFEST_SQL} GROUP BY ROLLUP (source, 2, 3)
""".replace("ROLLUP (source, 2, 3)", "ROLLUP (source, coalesce(metadata.subject, '(unorganised)'), coalesce(metadata.doc_type, '(unorganised)'))"))
def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    return MF.subject_counts(MF.current(table(spark, d, "manifest")))


@query("""
    WITH p AS (SELECT DISTINCT user_id, doc_id, rel_path, string_split(rel_path, '/') AS parts FROM manifest),
    k AS (SELECT DISTINCT subject FROM documents WHERE subject IS NOT NULL)
    SELECT user_id, doc_id, rel_path, CASE WHEN len(parts) >= 3 THEN parts[1] END AS folder, CASE WHEN len(parts) >= 3 THEN parts[2] END AS doc_type, parts[-1] AS file,
    CASE WHEN len(parts) < 3 THEN 'no label: the file lies outside a subject folder and a document type folder' WHEN k.subject IS NULL THEN 'unknown subject folder ' || parts[1]
         WHEN parts[2] NOT IN ('theory', 'labs', 'exercises', 'exams') THEN 'unknown document type folder ' || parts[2] END AS error
    FROM p LEFT JOIN k ON len(parts) >= 3 AND k.subject = parts[1]
""")
def folder_metadata(spark: SparkSession, d: str) -> DataFrame:
    subject, kind, name = M.folder_hint(F.col("rel_path"))
    rows = table(spark, d, "manifest").select(*KEY, "rel_path").distinct().select("*", subject.alias("folder"), kind.alias("doc_type"), name.alias("file"))
    known = table(spark, d, "documents").select(F.col("subject").alias("folder"), F.col("subject").alias("known")).where("known is not null").distinct()
    return rows.join(known, "folder", "left").select(*KEY, "rel_path", "folder", "doc_type", "file", M.label_error(F.col("folder"), F.col("known"), F.col("doc_type"), True).alias("error"))


@query(r"""
    WITH n AS (SELECT DISTINCT string_split(rel_path, '/')[-1] AS file FROM manifest),
    x AS (SELECT file, regexp_extract(file, '(?:^|[^0-9])(20[0-9]{2})[-_/](20[0-9]{2}|[0-9]{2})(?:[^0-9]|$)', ['a', 'b']) AS e,
          list_filter(list_transform(string_split_regex(file, '[^0-9]+'), lambda s: CASE WHEN length(s) = 4 THEN s END), lambda s: s IS NOT NULL AND TRY_CAST(s[1:2] AS INT) BETWEEN 10 AND 50 AND (TRY_CAST(s[1:2] AS INT) + 1) % 100 = TRY_CAST(s[3:4] AS INT)) AS c FROM n)
    SELECT file, coalesce(CASE WHEN e.a <> '' AND (TRY_CAST(e.a AS INT) + 1) % 100 = TRY_CAST(e.b AS INT) % 100 THEN e.a || '-' || lpad(CAST(TRY_CAST(e.b AS INT) % 100 AS VARCHAR), 2, '0') END,
                          CASE WHEN len(c) > 0 THEN '20' || c[1][1:2] || '-' || c[1][3:4] END) AS academic_year FROM x
""")
def year_from_name(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "manifest").select(F.element_at(F.split("rel_path", "/"), -1).alias("file")).distinct()
    return names.select("file", M.year_from_filename(F.col("file")).alias("academic_year"))


@query(f"SELECT user_id, doc_id, source, rel_path FROM {MANIFEST_SQL} WHERE doc_id ILIKE 'tema\\_%' ESCAPE '\\' OR rel_path ILIKE '%tema\\_%' ESCAPE '\\' OR rel_path ILIKE '%TEMA7\\_%' ESCAPE '\\'")
def find_documents(spark: SparkSession, d: str) -> DataFrame:
    return MF.current(table(spark, d, "manifest")).where(MF.matches("tema_") | MF.matches("TEMA7_")).select(*KEY, "source", "rel_path")


@query(f"""
    WITH s AS (SELECT * FROM stages WHERE output IS NOT NULL AND completed_at IS NOT NULL AND stage = 'extract' QUALIFY row_number() OVER (PARTITION BY user_id, doc_id ORDER BY completed_at DESC, version DESC, output DESC) = 1),
    x AS (SELECT DISTINCT user_id, doc_id FROM extracted)
    SELECT m.user_id, m.doc_id, CASE WHEN coalesce(s.version = 'pymupdf-3', false) AND x.doc_id IS NOT NULL THEN 'up_to_date' ELSE 'to_do' END AS status
    FROM {MANIFEST_SQL} m LEFT JOIN s USING (user_id, doc_id) LEFT JOIN x ON x.user_id = m.user_id AND x.doc_id = m.doc_id
""")
def stage_gate(spark: SparkSession, d: str) -> DataFrame:
    return MF.stage_gate(MF.current(table(spark, d, "manifest")), MF.current_stages(table(spark, d, "stages")), "extract", F.lit("pymupdf-3"), table(spark, d, "extracted"))


# the manifest read and changed


@query(f"SELECT user_id, doc_id, source, rel_path, row_number() OVER (PARTITION BY user_id ORDER BY source, rel_path, doc_id) AS place FROM {MANIFEST_SQL}")
def listed_documents(spark: SparkSession, d: str) -> DataFrame:
    return MF.listed(MF.current(table(spark, d, "manifest"))).select(*KEY, "source", "rel_path", "place")


def _first_document(spark: SparkSession, d: str) -> tuple[str, str]:
    return tuple(MF.current(table(spark, d, "manifest")).agg(F.min(F.struct(*KEY)).alias("k")).select("k.*").first())


FIRST_SQL = f"(SELECT user_id, doc_id FROM {MANIFEST_SQL} ORDER BY user_id, doc_id LIMIT 1)"


@query(f"SELECT user_id, doc_id, source, rel_path FROM {MANIFEST_SQL} SEMI JOIN {FIRST_SQL} k USING (user_id, doc_id)")
def document_by_key(spark: SparkSession, d: str) -> DataFrame:
    return MF.get(MF.current(table(spark, d, "manifest")), *_first_document(spark, d)).select(*KEY, "source", "rel_path")


@query(f"SELECT m.user_id, m.doc_id, m.source, m.rel_path FROM {MANIFEST_SQL} m WHERE (m.user_id, m.source) = (SELECT (user_id, min(source)) FROM {MANIFEST_SQL} GROUP BY user_id ORDER BY user_id LIMIT 1)")
def documents_of_user(spark: SparkSession, d: str) -> DataFrame:
    rows = MF.current(table(spark, d, "manifest"))
    user = rows.agg(F.min("user_id")).first()[0]
    source = rows.where(F.col("user_id") == user).agg(F.min("source")).first()[0]
    return MF.documents(rows, user, source).select(*KEY, "source", "rel_path")


STAGES_SQL = "(SELECT * FROM stages WHERE output IS NOT NULL AND completed_at IS NOT NULL AND user_id IS NOT NULL AND doc_id IS NOT NULL AND stage IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, doc_id, stage ORDER BY completed_at DESC, version DESC, output DESC) = 1)"


@query(f"SELECT user_id, doc_id, stage, version, output FROM {STAGES_SQL} SEMI JOIN {FIRST_SQL} k USING (user_id, doc_id) WHERE stage = 'chunk'")
def stage_of_document(spark: SparkSession, d: str) -> DataFrame:
    return MF.stage(MF.current_stages(table(spark, d, "stages")), *_first_document(spark, d), "chunk").select(*KEY, "stage", "version", "output")


@query(f"""
    WITH done AS (SELECT user_id, doc_id, 'extract' AS stage, 'text-9' AS version FROM {MANIFEST_SQL} WHERE regexp_matches(doc_id, '^[0-3]'))
    SELECT user_id, doc_id, stage, version FROM {STAGES_SQL} ANTI JOIN done USING (user_id, doc_id, stage) UNION ALL SELECT * FROM done
""")
def stages_after_run(spark: SparkSession, d: str) -> DataFrame:
    """The log after an extract run over the documents whose id begins with 0 to 3."""
    keys = MF.current(table(spark, d, "manifest")).select(*KEY).where(F.col("doc_id").rlike("^[0-3]"))
    done = keys.select(*KEY, F.lit("extract").alias("stage"), F.lit("text-9").alias("version"), F.lit("o").alias("output"), F.current_timestamp().alias("completed_at"))
    return MF.mark_done(MF.current_stages(table(spark, d, "stages")), done).select(*KEY, "stage", "version")


@query(f"SELECT stage, version, count(*) AS n FROM {STAGES_SQL} GROUP BY ALL")
def stage_totals(spark: SparkSession, d: str) -> DataFrame:
    return MF.stage_totals(MF.current_stages(table(spark, d, "stages")))


@query(f"""
    SELECT user_id, doc_id, CASE WHEN regexp_matches(doc_id, '^1') THEN 'moved/' || rel_path ELSE rel_path END AS rel_path,
           CASE WHEN regexp_matches(doc_id, '^1') THEN epoch_us(TIMESTAMP '2026-01-01') ELSE epoch_us(updated_at) END AS updated_us FROM {MANIFEST_SQL}
""")
def moved_documents(spark: SparkSession, d: str) -> DataFrame:
    """The manifest after the documents whose id begins with 1 have moved."""
    rows = MF.current(table(spark, d, "manifest"))
    moved = rows.where(F.col("doc_id").rlike("^1")).withColumn("rel_path", F.concat(F.lit("moved/"), "rel_path"))
    return MF.update_location(rows, moved, F.to_timestamp(F.lit("2026-01-01"))).select(*KEY, "rel_path", F.unix_micros("updated_at").alias("updated_us"))


@query(f"SELECT user_id, doc_id, source, rel_path FROM {MANIFEST_SQL}")
def added_documents(spark: SparkSession, d: str) -> DataFrame:
    """The manifest without the documents whose id begins with 0, after they are added to it."""
    rows = MF.current(table(spark, d, "manifest"))
    return MF.add(rows.where(~F.col("doc_id").rlike("^0")), rows.where(F.col("doc_id").rlike("^0"))).select(*KEY, "source", "rel_path")


@query(REGISTER_SQL + "SELECT user_id, doc_id, old_source AS source, old_path AS rel_path FROM old WHERE NOT EXISTS (SELECT 1 FROM statuses s WHERE s.status = 'missing' AND s.user_id = old.user_id AND s.doc_id = old.doc_id)")
def pruned_manifest(spark: SparkSession, d: str) -> DataFrame:
    return MF.prune(_older(spark, d), missing_documents(spark, d)).select(*KEY, "source", "rel_path")


@query(r"""
    SELECT DISTINCT rel_path, CASE WHEN e IN ('.txt', '.md') THEN 'text-1' WHEN e IN ('.html', '.htm') THEN 'html-1' WHEN e = '.pdf' THEN 'pdf-2' END AS version
    FROM (SELECT rel_path, lower(regexp_extract(rel_path, '(\.[^./]*)$', 1)) AS e FROM manifest)
""")
def extractor_versions(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "manifest").select("rel_path").distinct()
    return paths.select("rel_path", extractor_version(default_registry(), F.col("rel_path")).alias("version"))


@query(r"""
    SELECT DISTINCT user_id, doc_id, metadata.subject AS subject, metadata.academic_year AS academic_year, regexp_matches(metadata.subject, '^[a-z0-9_]+$') AS is_slug,
           CASE WHEN regexp_matches(metadata.academic_year, '^[0-9]{4}-[0-9]{2}$') THEN (metadata.academic_year[1:4]::INT + 1) % 100 = metadata.academic_year[6:7]::INT WHEN metadata.academic_year IS NOT NULL THEN false END AS is_year FROM manifest
""")
def label_checks(spark: SparkSession, d: str) -> DataFrame:
    subject, year = F.col("metadata.subject"), F.col("metadata.academic_year")
    return table(spark, d, "manifest").select(*KEY, subject.alias("subject"), year.alias("academic_year"), M.is_slug(subject).alias("is_slug"), M.is_academic_year(year).alias("is_year")).distinct()


@query(f"""
    WITH e AS (SELECT DISTINCT user_id, doc_id, extractor FROM extracted WHERE extractor IS NOT NULL), x AS (SELECT DISTINCT user_id, doc_id FROM chunked),
    s AS (SELECT * FROM {STAGES_SQL} WHERE stage = 'chunk'), v AS (SELECT max(version) AS v FROM current_versions WHERE stage = 'chunk')
    SELECT m.user_id, m.doc_id, e.extractor, CASE WHEN coalesce(s.version = v || ':' || e.extractor, false) AND x.doc_id IS NOT NULL THEN 'up_to_date' ELSE 'to_do' END AS status
    FROM {MANIFEST_SQL} m JOIN e USING (user_id, doc_id) CROSS JOIN v LEFT JOIN s ON s.user_id = m.user_id AND s.doc_id = m.doc_id LEFT JOIN x ON x.user_id = m.user_id AND x.doc_id = m.doc_id
""")
def chunk_gate(spark: SparkSession, d: str) -> DataFrame:
    """Which extracted documents the chunk stage has to do: its version goes by that of the extractor."""
    rule = table(spark, d, "current_versions").where("stage = 'chunk'").agg(F.max("version")).first()[0]
    documents = MF.current(table(spark, d, "manifest")).select(*KEY).join(table(spark, d, "extracted").select(*KEY, "extractor").where("extractor is not null").distinct(), KEY)
    gate = MF.stage_gate(documents, MF.current_stages(table(spark, d, "stages")), "chunk", F.concat(F.lit(rule), F.lit(":"), "extractor"), table(spark, d, "chunked"), ["extractor"])
    return gate.select(*KEY, "extractor", "status")


# extracting


@query(rf"""
    SELECT DISTINCT user_id, doc_id, number, {STRIP(r"regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '" + LE + r"', chr(10), 'g'), '(?m)" + B.replace(chr(92) + "n", "") + r"+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM pages
""")
def normalise_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(*KEY, "number", T.normalise_text(F.col("text")).alias("text")).distinct()


@query(f"""
    SELECT DISTINCT user_id, doc_id, number, length(coalesce(text, '')) AS char_count, {WORDS("coalesce(text, '')")} AS word_count, length(coalesce(text, '')) < 80 AS mostly_image, coalesce(text, '') = '' AS empty,
           CASE WHEN width > height THEN 'landscape' ELSE 'portrait' END AS orientation, round_even(width, 1) AS width, round_even(height, 1) AS height FROM pages
""")
def page_facts(spark: SparkSession, d: str) -> DataFrame:
    return extracting.page_facts(table(spark, d, "pages"))


@query("""
    WITH p AS (SELECT user_id, doc_id, number, max(language) AS language FROM pages WHERE language IS NOT NULL GROUP BY ALL),
    c AS (SELECT user_id, doc_id, language, count(*) AS n, min(number) AS first FROM p GROUP BY ALL)
    SELECT user_id, doc_id, string_agg(language, ',' ORDER BY n DESC, first, language) AS languages FROM c GROUP BY ALL
""")
def document_languages(spark: SparkSession, d: str) -> DataFrame:
    return extracting.document_languages(table(spark, d, "pages")).select(*KEY, F.array_join("languages", ",").alias("languages"))


@query(r"""
    WITH d AS (SELECT lang AS label, ' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ' AS t FROM documents WHERE text IS NOT NULL AND lang IN ('ca', 'en', 'es', 'fr')),
    c AS (SELECT label, gram, count(*) AS n FROM (SELECT label, unnest(list_transform(range(1, length(t) - 1), lambda i: t[i:i + 2])) AS gram FROM d) GROUP BY ALL),
    top AS (SELECT gram FROM c GROUP BY gram ORDER BY sum(n) DESC, gram LIMIT 20000),
    k AS (SELECT gram, label, coalesce(n, 0) + 0.5 AS n FROM top CROSS JOIN (SELECT unnest(['ca', 'en', 'es', 'fr']) AS label) LEFT JOIN c USING (gram, label)),
    s AS (SELECT gram, label, ln(n / sum(n) OVER (PARTITION BY label)) AS score FROM k),
    p AS (SELECT DISTINCT user_id, doc_id, number, text FROM pages),
    f AS (SELECT user_id, doc_id, number, ' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ' AS t FROM p WHERE length(regexp_replace(text, '[^\p{L}]+', '', 'g')) >= 20),
    g AS (SELECT user_id, doc_id, number, gram, count(*) AS n FROM (SELECT user_id, doc_id, number, unnest(list_transform(range(1, length(t) - 1), lambda i: t[i:i + 2])) AS gram FROM f) GROUP BY ALL),
    t AS (SELECT user_id, doc_id, number, label, sum(n * score) AS total FROM g JOIN s USING (gram) GROUP BY ALL),
    b AS (SELECT user_id, doc_id, number, arg_max(label, total) AS label, 1 / sum(exp(total - m)) AS confidence FROM (SELECT *, max(total) OVER (PARTITION BY user_id, doc_id, number) AS m FROM t) GROUP BY ALL)
    SELECT user_id, doc_id, number, CASE WHEN confidence >= 0.8 THEN label END AS language FROM p LEFT JOIN b USING (user_id, doc_id, number)
""")
def detected_languages(spark: SparkSession, d: str) -> DataFrame:
    """Page languages by the trigram model, fitted on all labelled documents; null where unsure."""
    documents = table(spark, d, "documents")
    model = TrigramModel(trigram_counts(documents, "text", "lang"), ("ca", "en", "es", "fr"))
    return table(spark, d, "pages").select(*KEY, "number", "text").distinct().select(*KEY, "number", model.column(F.col("text")).alias("language"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Text spans derived from page lines: sizes and places come from the line's number and length."""
    pages = cleaning.distinct_pages(table(spark, d, "pages"))
    lines = pages.select(*KEY, "number", F.posexplode(T.lines(F.col("text"))).alias("ord", "text"))
    size = (F.lit(10) + F.length("text") % 7).cast("double")
    return lines.select(*KEY, "number", "ord", "text", size.alias("size"), (F.col("ord") * 40 % 800).cast("double").alias("top"), F.lit(800.0).alias("page_height"))


SPANS_SQL = f"""
    WITH l AS (SELECT user_id, doc_id, number, regexp_split_to_array(text, '{LE}') AS a FROM {PAGES_SQL} WHERE text <> ''),
    k AS (SELECT user_id, doc_id, number, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM l),
    spans AS (SELECT user_id, doc_id, number, ord - 1 AS ord, text, (10 + length(text) % 7)::DOUBLE AS size, ((ord - 1) * 40 % 800)::DOUBLE AS top FROM (SELECT user_id, doc_id, number, unnest(a) AS text, generate_subscripts(a, 1) AS ord FROM k)),
    solid AS (SELECT *, {STRIP("text")} AS t FROM spans WHERE {STRIP("text")} <> ''),
    body AS (SELECT user_id, doc_id, number, median(size) AS body_size FROM (SELECT user_id, doc_id, number, size, unnest(range(length(text))) AS i FROM solid) GROUP BY ALL)
"""


@query(SPANS_SQL + "SELECT * FROM body")
def weighted_median_size(spark: SparkSession, d: str) -> DataFrame:
    return extracting.weighted_median_size(_spans(spark, d), [*KEY, "number"])


@query(SPANS_SQL + rf"""
    , c AS (SELECT s.*, body_size, top < 240 AND regexp_matches(text, '[\p{{L}}\p{{N}}]') AS candidate FROM solid s JOIN body USING (user_id, doc_id, number)),
    m AS (SELECT *, max(CASE WHEN candidate THEN size END) OVER (PARTITION BY user_id, doc_id, number) AS largest FROM c),
    j AS (SELECT user_id, doc_id, number, {COLLAPSE("coalesce(string_agg(t, ' ' ORDER BY ord) FILTER (candidate AND size >= largest - 0.5 AND largest >= body_size * 1.15), '')")} AS t FROM m GROUP BY ALL)
    SELECT user_id, doc_id, number, CASE WHEN t <> '' THEN t[1:200] END AS title FROM j
""")
def title_guess(spark: SparkSession, d: str) -> DataFrame:
    return extracting.guess_titles(_spans(spark, d), [*KEY, "number"])


# cleaning

LINES_SQL = rf"""
    WITH p AS {PAGES_SQL},
    a AS (SELECT user_id, doc_id, number, place, n_pages, regexp_split_to_array(text, '{LE}') AS a FROM p WHERE text <> ''),
    b AS (SELECT * REPLACE (CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a) FROM a),
    u AS (SELECT user_id, doc_id, number, place, n_pages, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS i FROM b),
    l AS (SELECT *, {STRIP("line")} AS stripped, lower({COLLAPSE("line")}) AS key FROM u),
    l2 AS (SELECT *, length(stripped) BETWEEN 1 AND 100 AND regexp_matches(stripped, '\p{{L}}') AS can, min(CASE WHEN stripped <> '' THEN i END) OVER w AS lo, max(CASE WHEN stripped <> '' THEN i END) OVER w AS hi FROM l WINDOW w AS (PARTITION BY user_id, doc_id, number)),
    bp AS (SELECT user_id, doc_id, key, count(DISTINCT number) AS n_pages FROM l2 WHERE can GROUP BY user_id, doc_id, key HAVING count(DISTINCT number) >= greatest(3, ceil(0.5 * max(l2.n_pages)))),
    j AS (SELECT l2.*, bp.key IS NOT NULL AND stripped <> '' AS is_boilerplate, i IN (lo, hi) AND regexp_matches(stripped, '^[0-9]{{1,4}}$') AND try_cast(stripped AS INT) >= 1 AND place - try_cast(stripped AS INT) BETWEEN 0 AND 2 AS num
          FROM l2 LEFT JOIN bp ON bp.user_id = l2.user_id AND bp.doc_id = l2.doc_id AND bp.key = l2.key),
    judged AS (SELECT *, coalesce(num, false) AND NOT is_boilerplate AS is_number FROM j)
"""
REMOVED_SQL = LINES_SQL + rf"""
    , removed AS (SELECT user_id, doc_id, coalesce(arg_min(CASE WHEN NOT is_number THEN {COLLAPSE("stripped")} END, place * 1000000 + i), '(page number)') AS text, count(*) AS n_removed
    FROM judged WHERE is_boilerplate OR is_number GROUP BY user_id, doc_id, CASE WHEN NOT is_number THEN key END)
"""


@query(LINES_SQL + "SELECT key, count(*) AS n, count(DISTINCT (user_id, doc_id)) AS n_documents FROM judged WHERE can GROUP BY ALL")
def line_keys(spark: SparkSession, d: str) -> DataFrame:
    lines = cleaning.page_lines(cleaning.distinct_pages(table(spark, d, "pages")), 100).where("can")
    per_document = lines.groupBy(*KEY, "key").agg(F.count("*").alias("n"))
    return per_document.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("n_documents"))


@query(LINES_SQL + "SELECT user_id, doc_id, key, n_pages FROM bp")
def boilerplate_lines(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.boilerplate_keys(table(spark, d, "pages"))


@query(REMOVED_SQL + "SELECT * FROM removed")
def removed_lines(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.removed_lines(table(spark, d, "pages"))


@query(REMOVED_SQL + "SELECT text, count(DISTINCT (user_id, doc_id)) AS n_documents FROM removed GROUP BY text")
def boilerplate_audit(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.boilerplate_audit(removed_lines(spark, d))


@query(LINES_SQL + rf"""
    , t AS (SELECT user_id, doc_id, number, string_agg(line, chr(10) ORDER BY i) FILTER (NOT is_boilerplate AND NOT is_number) AS text FROM judged GROUP BY ALL)
    SELECT p.user_id, p.doc_id, p.number, coalesce({STRIP(r"regexp_replace(t.text, '\n{3,}', chr(10) || chr(10), 'g')")}, '') AS text FROM p LEFT JOIN t USING (user_id, doc_id, number)
""")
def cleaned_pages(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.cleaned_pages(table(spark, d, "pages"))


@query(LINES_SQL + "SELECT user_id, doc_id, number, i, stripped FROM judged WHERE is_number")
def page_numbers_removed(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.judged_lines(table(spark, d, "pages")).where("is_number").select(*KEY, "number", "i", "stripped")


# chunking


@query(f"SELECT doc_id, {WORDS('text')} AS n_words FROM documents")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"))


def _documents_with_paths(spark: SparkSession, d: str) -> DataFrame:
    return MF.current(table(spark, d, "manifest")).select(*KEY, "rel_path", "source", "metadata", F.col("metadata.subject").alias("subject"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "documents").select("subject").where("subject is not null").distinct()
    return known.select("subject", F.initcap(F.translate("subject", "_", " ")).alias("name"))


NAME_SQL = "array_to_string(list_transform(string_split(translate(subject, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
PLACE = "user_id, doc_id, number"
CHUNKS_SQL = LINES_SQL.replace("WITH p AS", "WITH RECURSIVE p AS", 1) + rf"""
    , t AS (SELECT {PLACE}, string_agg(line, chr(10) ORDER BY i) FILTER (NOT is_boilerplate AND NOT is_number) AS text FROM judged GROUP BY ALL),
    m AS (SELECT {PLACE}, max(title) AS title, max(language) AS language FROM pages GROUP BY ALL),
    clean AS (SELECT {PLACE}, {STRIP(r"regexp_replace(t.text, '\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM t),
    c AS (SELECT {PLACE}, text, {WORDS("text")} AS n FROM clean WHERE {WORDS("text")} >= 5),
    blocks AS (SELECT {PLACE}, unnest(a) AS block, generate_subscripts(a, 1) AS bi FROM (SELECT *, regexp_split_to_array(text, '\n{B}*\n') AS a FROM c WHERE n > 450)),
    l0 AS (SELECT {PLACE}, bi, CASE WHEN {WORDS("block")} <= 450 THEN [block] ELSE regexp_split_to_array(block, '{LE}') END AS a FROM blocks),
    l1 AS (SELECT {PLACE}, bi, unnest(a) AS line, generate_subscripts(a, 1) AS li FROM l0),
    l3 AS (SELECT *, list_filter(regexp_split_to_array(line, '{B}+'), lambda w: w <> '') AS w FROM l1),
    l4 AS (SELECT {PLACE}, bi, li, CASE WHEN len(w) <= 450 THEN [line] ELSE list_transform(range(0, len(w), 450), lambda i: array_to_string(w[i + 1:i + 450], ' ')) END AS a FROM l3),
    units0 AS (SELECT {PLACE}, bi, li, unnest(a) AS x, generate_subscripts(a, 1) AS wi FROM l4),
    units AS (SELECT {PLACE}, {STRIP("x")} AS text, {WORDS("x")} AS n, row_number() OVER (PARTITION BY {PLACE} ORDER BY bi, li, wi) AS i FROM units0 WHERE {WORDS("x")} > 0),
    r AS (SELECT {PLACE}, i, n AS total, 0 AS bin FROM units WHERE i = 1
          UNION ALL SELECT units.user_id, units.doc_id, units.number, units.i, CASE WHEN r.total < 350 AND r.total + units.n <= 450 THEN r.total + units.n ELSE units.n END, CASE WHEN r.total < 350 AND r.total + units.n <= 450 THEN r.bin ELSE r.bin + 1 END
          FROM r JOIN units ON units.user_id = r.user_id AND units.doc_id = r.doc_id AND units.number = r.number AND units.i = r.i + 1),
    sizes AS (SELECT {PLACE}, bin, sum(n) AS n FROM r JOIN units USING ({PLACE}, i) GROUP BY ALL),
    e AS (SELECT *, max(bin) OVER (PARTITION BY {PLACE}) AS hi, lag(n) OVER (PARTITION BY {PLACE} ORDER BY bin) AS before FROM sizes),
    rest AS (SELECT {PLACE}, bin, 1 AS back FROM e WHERE bin = hi AND hi > 0 AND n < 350 // 4 AND before + n <= 450),
    parts AS (SELECT {PLACE}, bin - coalesce(back, 0) AS part, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text FROM r JOIN units USING ({PLACE}, i) LEFT JOIN rest USING ({PLACE}, bin) GROUP BY ALL),
    cut AS (SELECT {PLACE}, 0 AS part, text FROM c WHERE n <= 450 UNION ALL SELECT {PLACE}, part, text FROM parts),
    o AS (SELECT cut.*, title, language, row_number() OVER (PARTITION BY user_id, doc_id ORDER BY number, part) - 1 AS chunk_index FROM cut JOIN m USING ({PLACE})),
    h AS (SELECT o.*, rel_path, metadata.subject AS subject, sha1(unhex('{chunking.NAMESPACE.hex}') || encode(concat_ws('|', user_id, doc_id, chunk_index, text))) AS h FROM o JOIN {MANIFEST_SQL} USING (user_id, doc_id)),
    k AS (SELECT DISTINCT subject, {NAME_SQL} AS name FROM documents WHERE subject IS NOT NULL),
    made AS (SELECT user_id, doc_id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], lower(hex(((('0x' || h[17:18])::INT & 63) | 128)::UTINYINT::BIGINT)) || h[19:20], h[21:32]) AS chunk_id, chunk_index, number AS page, part, title,
             concat_ws(' · ', name, translate(regexp_replace(string_split(rel_path, '/')[-1], '(.)\.[^.]*$', '\1'), '_-', '  '), coalesce(nullif(title, ''), 'p. ' || number)) AS header, text, {WORDS("text")} AS word_count, language
             FROM h LEFT JOIN k USING (subject))
"""


@query(CHUNKS_SQL + "SELECT * FROM made")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """All pages cleaned and cut into chunks."""
    clean = cleaning.cleaned_pages(table(spark, d, "pages"), columns=("title", "language"))
    return chunking.make_chunks(clean, _documents_with_paths(spark, d), _subjects(spark, d))


@query(CHUNKS_SQL + "SELECT user_id, doc_id, count(*) AS n_chunks, sum(word_count) AS n_words, max(part) AS most_parts FROM made GROUP BY ALL")
def chunk_totals(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).groupBy(*KEY).agg(F.count("*").alias("n_chunks"), F.sum("word_count").alias("n_words"), F.max("part").alias("most_parts"))


@query(f"SELECT DISTINCT chunk_id, {COLLAPSE('text')}[1:120] AS snippet FROM chunks")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", T.snippet(F.col("text")).alias("snippet")).distinct()


CHUNK_RULES = {"max_words": chunking.MAX_WORDS, "target_words": chunking.TARGET_WORDS, "min_words": chunking.MIN_WORDS}


@query(f"SELECT DISTINCT extractor, 'chunker-{chunking.CHUNKER}:{chunking.settings_digest(CHUNK_RULES)}:' || extractor AS chunker FROM extracted WHERE extractor IS NOT NULL")
def chunker_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted").select("extractor").where("extractor is not null").distinct()
    return rows.select("extractor", chunking.chunker_version(CHUNK_RULES, F.col("extractor")).alias("chunker"))


@query(f"""
    WITH h AS (SELECT DISTINCT user_id, doc_id, chunk_index, page, part, text, sha1(unhex('{chunking.NAMESPACE.hex}') || encode(concat_ws('|', user_id, doc_id, chunk_index, text))) AS h FROM chunks)
    SELECT user_id, doc_id, chunk_index, page, part, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], lower(hex(((('0x' || h[17:18])::INT & 63) | 128)::UTINYINT::BIGINT)) || h[19:20], h[21:32]) AS own_id FROM h
""")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select(*KEY, "chunk_index", "page", "part", "text").distinct()
    return rows.select(*KEY, "chunk_index", "page", "part", chunking.uuid5(F.concat_ws("|", "user_id", "doc_id", F.col("chunk_index").cast("string"), "text")).alias("own_id"))


@query(rf"""
    WITH c AS (SELECT DISTINCT user_id, doc_id, chunk_id, page, title, text FROM chunks),
    h AS (SELECT c.user_id, c.doc_id, chunk_id, text, concat_ws(' · ', k.subject, translate(regexp_replace(string_split(rel_path, '/')[-1], '(.)\.[^.]*$', '\1'), '_-', '  '), coalesce(nullif(title, ''), 'p. ' || page)) AS header
          FROM c JOIN {MANIFEST_SQL} m USING (user_id, doc_id) LEFT JOIN (SELECT DISTINCT subject FROM documents WHERE subject IS NOT NULL) k ON k.subject = m.metadata.subject)
    SELECT user_id, doc_id, chunk_id, header, md5(header || chr(10) || chr(10) || text) AS embedding_text_md5 FROM h
""")
def chunk_headers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select(*KEY, "chunk_id", "page", "title", "text").distinct().join(_documents_with_paths(spark, d), KEY)
    named = rows.join(_subjects(spark, d).select("subject", F.col("subject").alias("name")), "subject", "left")
    headed = named.select(*KEY, "chunk_id", "text", chunking.header(F.col("name"), F.col("rel_path"), F.col("title"), F.col("page")).alias("header"))
    return headed.select(*KEY, "chunk_id", "header", F.md5(embedding_text(F.col("header"), F.col("text"))).alias("embedding_text_md5"))


# vectors


@query(r"""
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents)
    SELECT doc_id, (('0x' || md5(w)[1:8])::BIGINT % 64)::INT AS bucket, count(*) AS n FROM w GROUP BY ALL
""")
def word_buckets(spark: SparkSession, d: str) -> DataFrame:
    return vectors.word_buckets(table(spark, d, "documents"), "doc_id")


@query(r"""
    WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i]::BIGINT[] || [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))),
    w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents),
    b AS (SELECT w, list_transform(range(0, octet_length(encode(w))), lambda k: ('0x' || hex(encode(w))[2 * k + 1:2 * k + 2])::BIGINT) AS bytes FROM (SELECT DISTINCT w FROM w)),
    k AS (SELECT w, xor(list_reduce([4294967295]::BIGINT[] || bytes, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 64 AS place FROM b, tab)
    SELECT doc_id, place::INT AS place, count(*) AS n FROM w JOIN k USING (w) GROUP BY ALL
""")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of all documents, their entries listed: the number of words in each place."""
    rows = vectors.hash_embedding(table(spark, d, "documents").select("doc_id", "text"))
    entries = rows.select("doc_id", F.posexplode("embedding").alias("place", "n"))
    return entries.select("doc_id", "place", F.round("n").cast("bigint").alias("n")).where("n > 0")


def _question(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


SCORE_SQL = "SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q {} ORDER BY score DESC, vec_id LIMIT 5"


@query(SCORE_SQL.format(""))
def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return vectors.search(table(spark, d, "embeddings"), _question(spark, d), key="vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(SCORE_SQL.format("WHERE e.label = 3"))
def topk_cosine_filtered(spark: SparkSession, d: str) -> DataFrame:
    return vectors.search(table(spark, d, "embeddings"), _question(spark, d), F.col("label") == 3, key="vec_id").select("vec_id", F.round("score", 6).alias("score"))


SEARCH_SQL = """
    WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score, e.label = q.label AS good
               FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s)
"""


@query(SEARCH_SQL + "SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def search_all(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 50 asked against all rows."""
    rows = table(spark, d, "embeddings")
    return vectors.search_all(rows, rows.where("vec_id % 50 = 0")).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(SEARCH_SQL + """
    , b AS (SELECT query_id, min(CASE WHEN good AND rank BETWEEN 2 AND 6 THEN rank - 1 END) AS best FROM r GROUP BY ALL)
    SELECT count(*) AS n_queries, round(avg(CASE WHEN best IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hit_at_k, round(avg(coalesce(1.0 / best, 0.0)), 6) AS mrr FROM b
""")
def retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    """hit@5 and MRR of the nearest other rows; a row of the question's label is relevant."""
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 50 = 0")
    ranked = vectors.search_all(rows, asked, k=6).where("rank > 1").select("query_id", F.col("vec_id").alias("item"), (F.col("rank") - 1).alias("rank"))
    truth = asked.select(F.col("vec_id").alias("query_id"), "label").join(rows.select(F.col("vec_id").alias("item"), "label"), "label")
    return vectors.retrieval_quality(ranked, truth)


@query("SELECT vec_id, score, label, rank FROM (SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY e.label ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE rank <= 3")
def topk_per_label(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    question = F.array(*[F.lit(float(x)) for x in _question(spark, d)])
    scored = table(spark, d, "embeddings").select("vec_id", "label", F.round(vectors.cosine(F.col("embedding"), question), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy(F.desc("score"), "vec_id"))).where("rank <= 3").select("vec_id", "score", "label", "rank")


@query("SELECT user_id, doc_id, count(DISTINCT chunk_id) AS n_points FROM chunks GROUP BY ALL")
def point_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select(*KEY, "chunk_id").distinct().groupBy(*KEY).agg(F.count("*").alias("n_points"))


def _points(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored points, and new ones of the documents whose id begins with a digit: without odd places, with new ids at places by ten."""
    old = table(spark, d, "chunks").select(*KEY, "chunk_id", "chunk_index").distinct()
    new = old.where(F.col("doc_id").rlike("^[0-9]") & (F.col("chunk_index") % 2 == 0)).withColumn("chunk_id", F.when(F.col("chunk_index") % 10 == 0, F.concat("chunk_id", F.lit("n"))).otherwise(F.col("chunk_id")))
    return old, new


POINTS_SQL = """
    WITH old AS (SELECT DISTINCT user_id, doc_id, chunk_id, chunk_index FROM chunks),
    new AS (SELECT * REPLACE (CASE WHEN chunk_index % 10 = 0 THEN chunk_id || 'n' ELSE chunk_id END AS chunk_id) FROM old WHERE regexp_matches(doc_id, '^[0-9]') AND chunk_index % 2 = 0)
"""


@query(POINTS_SQL + "SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.user_id = old.user_id AND new.doc_id = old.doc_id) UNION ALL SELECT * FROM new")
def replace_document(spark: SparkSession, d: str) -> DataFrame:
    old, new = _points(spark, d)
    return vectors.replace_documents(old, new, new)


@query(POINTS_SQL + "SELECT * FROM old WHERE EXISTS (SELECT 1 FROM new WHERE new.user_id = old.user_id AND new.doc_id = old.doc_id) AND NOT EXISTS (SELECT 1 FROM new WHERE new.user_id = old.user_id AND new.doc_id = old.doc_id AND new.chunk_id = old.chunk_id)")
def stale_points(spark: SparkSession, d: str) -> DataFrame:
    old, new = _points(spark, d)
    return vectors.stale_points(old, new)


@query(POINTS_SQL + """
    , c AS (SELECT user_id, doc_id, count(*) AS n FROM old GROUP BY ALL), p AS (SELECT user_id, doc_id, count(*) AS n FROM (SELECT * FROM new UNION ALL SELECT * FROM old WHERE regexp_matches(doc_id, '^[a-f]')) GROUP BY ALL)
    SELECT m.user_id, m.doc_id FROM (SELECT DISTINCT user_id, doc_id FROM manifest WHERE user_id IS NOT NULL AND doc_id IS NOT NULL) m LEFT JOIN c USING (user_id, doc_id) LEFT JOIN p USING (user_id, doc_id) WHERE coalesce(c.n, 0) = coalesce(p.n, 0)
""")
def whole_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose stored points (here those of ids that begin with a letter, and new ones) are as many as their chunks, for the index gate."""
    old, new = _points(spark, d)
    return vectors.whole_documents(MF.current(table(spark, d, "manifest")).select(*KEY), old, new.unionByName(old.where(F.col("doc_id").rlike("^[a-f]"))))


@query(f"""
    WITH k AS (SELECT user_id, min(source) AS source FROM {MANIFEST_SQL} GROUP BY user_id ORDER BY user_id LIMIT 1)
    SELECT DISTINCT c.user_id, c.doc_id, chunk_id, m.source, language FROM chunks c JOIN {MANIFEST_SQL} m ON m.user_id = c.user_id AND m.doc_id = c.doc_id JOIN k ON k.user_id = c.user_id AND k.source = m.source WHERE language = 'ca'
""")
def tenant_points(spark: SparkSession, d: str) -> DataFrame:
    """One user's points of one source and language."""
    rows = MF.current(table(spark, d, "manifest"))
    user = rows.agg(F.min("user_id")).first()[0]
    source = rows.where(F.col("user_id") == user).agg(F.min("source")).first()[0]
    points = table(spark, d, "chunks").select(*KEY, "chunk_id", "language").distinct().join(rows.select(*KEY, "source"), KEY)
    return points.where(vectors.tenant(user, source=source, language="ca", subject=None)).select(*KEY, "chunk_id", "source", "language")


@query()
def search_cells(spark: SparkSession, d: str) -> DataFrame:
    """The approximate index over all rows, asked by every row whose id is divisible by 50; recall is tested against ``search_all``."""
    rows = table(spark, d, "embeddings")
    centres, probes = cells.fit(rows)
    found = cells.search(cells.assigned(rows, centres), rows.where("vec_id % 50 = 0"), centres, probes)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query()
def search_cells_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    asked, (centres, probes) = rows.where("vec_id % 50 = 0"), cells.fit(rows)
    return cells.recall(cells.search(cells.assigned(rows, centres), asked, centres, probes), vectors.search_all(rows, asked))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """The streaming aggregate run over the whole table."""
    return event_counts(table(spark, d, "events")).select(F.unix_micros(F.col("window_start").cast("timestamp")).alias("window_us"), "event_type", "n", "total")


@query()
def search_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Ingest and search: pages cleaned, cut, embedded with their headers, and asked one question."""
    embedder = HashEmbedder()
    rows = chunks(spark, d).where("language = 'en'").withColumn("_text", embedding_text(F.col("header"), F.col("text")))
    points = embedder.transform(rows, "_text").drop("_text")
    hits = vectors.search(points, embedder.embed(spark, ["the binary semaphore blocks the shared bus"])[0])
    return hits.select("chunk_id", *KEY, "page", "part", F.round("score", 6).alias("score"), T.snippet(F.col("text")).alias("snippet"))
