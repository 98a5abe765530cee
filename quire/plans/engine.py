"""The engine: register, extract, chunk, index, and search, each stage re-runnable alone.

Stage results are tables in the data directory, kept in buckets of documents; a stage reads, makes and
writes only what belongs to the documents that are not up to date. Everything is scoped to one user.
"""

from __future__ import annotations

from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire import schemas as S
from quire.functions import metadata as M, text as T
from quire.functions.language import TrigramModel
from quire.functions.stages import cut
from quire.operators import chunking, cleaning, extracting, manifest as MF, registering, vectors
from quire.operators.embedding import Embedder, embedder_for, embedding_text
from quire.plans.settings import ConfigError, Settings
from quire.sources import files as FS
from quire.sources.buckets import BucketTable
from quire.sources.loaders import Registry, default_registry, extractor_version, load_pages
from quire.sources.snapshots import SnapshotTable

KEY = ["user_id", "doc_id"]


class StoreError(RuntimeError):
    pass


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings, registry: Registry | None = None, embedder: Embedder | None = None, language_model: TrigramModel | None = None):
        self.spark, self.settings = spark, settings
        self.registry = registry or default_registry(settings.extraction.thumbnail_width)
        e = settings.embedding
        self.embedder = embedder or embedder_for(e.provider, e.model, e.dimension, e.batch_size, settings.embedder_url)
        self.language_model = language_model
        table = lambda name, schema: BucketTable(spark, f"{settings.data_dir}/{name}", schema, buckets=settings.buckets)
        self.manifest, self.stages = table("manifest", S.MANIFEST), table("stages", S.STAGES)
        self.pages, self.extracted, self.thumbnails = table("pages", S.PAGES), table("extracted", S.EXTRACTED), table("thumbnails", S.THUMBNAILS)
        self.chunks, self.removed, self.chunked = table("chunks", S.CHUNKS), table("removed_lines", S.REMOVED_LINES), table("chunked", S.CHUNKED)
        self.points = table("points", S.POINTS)
        self.collection = SnapshotTable(spark, f"{settings.data_dir}/collection", "embedding_model string, dimension int")

    # stage 1

    def scan(self, source) -> DataFrame:
        """The files of a source with their labels and errors."""
        user = self.settings.user
        found = FS.identified(FS.scan(self.spark, source.root, self.registry.extensions), user.id, source.name)
        rows = [(k, k, s.taken_in, s.professor) for k, s in self.settings.subjects.items()]
        known = self.spark.createDataFrame(rows, "subject_dir string, known string, taken_in string, professor string")
        subject, kind, name = M.folder_hint(F.col("rel_path"))
        hinted = found.withColumn("subject_dir", subject).withColumn("doc_type", kind).withColumn("file", name)
        joined = hinted.join(known, "subject_dir", "left")
        label = F.struct(F.lit(user.university).alias("university"), F.lit(user.degree).alias("degree"), F.col("known").alias("subject"), "doc_type", "taken_in", M.year_from_filename(F.col("file")).alias("academic_year"), "professor")
        return joined.select(*found.columns, F.when(F.col("known").isNotNull(), label).alias("metadata"), M.label_error(F.col("subject_dir"), F.col("known"), F.col("doc_type"), source.labelled).alias("error"))

    def register(self, source: str = "all") -> DataFrame:
        """Stage 1 of the chosen sources, one after the other; the statuses of files and missing records."""
        reports = None
        everywhere = None
        for one in self.settings.sources.values():
            files = self.scan(one)
            everywhere = files if everywhere is None else everywhere.unionByName(files)
        everywhere = cut(everywhere)
        for one in self.settings.chosen(source):
            files = everywhere.where(F.col("source") == one.name)
            old = self.manifest.read()
            # files of other sources only say what is still there
            statuses = registering.register(everywhere, old).where(F.col("source") == one.name)
            statuses = cut(statuses)
            changed = statuses.where("status in ('new', 'moved')").select(*KEY).distinct()
            rows = registering.apply_statuses(old, files, statuses, F.date_trunc("second", F.current_timestamp())).join(changed, KEY, "left_semi")
            self.manifest.replace_documents(cut(rows), changed)
            reports = statuses if reports is None else reports.unionByName(statuses)
        return reports

    # stage 2

    def _done(self, documents: DataFrame, stage: str) -> DataFrame:
        """Stage rows of (user_id, doc_id, version, output)."""
        return documents.select(*KEY, F.lit(stage).alias("stage"), "version", "output", F.date_trunc("second", F.current_timestamp()).alias("completed_at"))

    def _mark(self, done: DataFrame) -> None:
        """Upsert of stage rows; only the log of the documents that are done is read."""
        done = cut(done)
        own = self.stages.read().join(done.select(*KEY), KEY, "left_semi")
        self.stages.replace_documents(cut(MF.mark_done(own, done)), done)

    def _to_do(self, documents: DataFrame, stage: str, outputs: DataFrame, force: bool) -> DataFrame:
        gate = MF.stage_gate(documents, self.stages.read(), stage, F.col("wanted"), outputs)
        return cut(documents.join(gate if force else gate.where("status = 'to_do'"), KEY).drop("status"))

    def extract(self, force: bool = False) -> DataFrame:
        """Stage 2: pages, facts, languages; (rel_path, status, detail) of each document that was due."""
        x = self.settings.extraction
        documents = self.manifest.read().withColumn("wanted", extractor_version(self.registry, F.col("rel_path"))).where("wanted is not null")
        due = self._to_do(documents, "extract", self.extracted.read(), force)
        # names and places of all files, bytes only of those that are due
        places = reduce(DataFrame.unionByName, [FS.scan(self.spark, one.root, self.registry.extensions, content=False).select(F.lit(one.name).alias("source"), "rel_path", "path") for one in self.settings.sources.values()])
        loaded = cut(load_pages(due.join(places, ["source", "rel_path"]).repartition(*KEY), self.registry, [*KEY, "source", "rel_path"]))
        failed = loaded.where("error is not null").select(*KEY, "rel_path", "error").dropDuplicates(KEY)
        good = loaded.join(failed.select(*KEY), KEY, "left_anti")
        text = T.normalise_text(F.col("text"))
        spans = good.where(F.size("spans") > 0).select(*KEY, "number", F.inline("spans"))
        titles = extracting.guess_titles(spans, [*KEY, "number"]).withColumnRenamed("title", "guessed")
        pages = good.join(titles, [*KEY, "number"], "left").withColumn("title", F.coalesce("title", "guessed")).withColumn("text", text)
        picture = F.when(F.col("thumbnail").isNotNull(), F.format_string("thumbnails/%s/%s/%d", "user_id", "doc_id", "number"))
        language = F.lit(None).cast("string") if self.language_model is None else self.language_model.column(F.col("text"), x.language_min_chars, x.language_min_confidence)
        pages = cut(pages.select(*KEY, "number", F.bround("width", 1).alias("width"), F.bround("height", 1).alias("height"), "title", "text", F.length("text").alias("char_count"), language.alias("language"), "image_count", (F.length("text") < x.image_page_max_chars).alias("mostly_image"), picture.alias("thumbnail")))
        heads = good.groupBy(*KEY, "source", "rel_path").agg(F.max("extractor").alias("extractor"))
        extracted = heads.join(extracting.document_languages(pages), KEY, "left").withColumn("languages", F.coalesce("languages", F.array().cast("array<string>")))
        self.pages.replace_documents(pages, heads)
        self.thumbnails.replace_documents(good.where("thumbnail is not null").select(*KEY, "number", F.col("thumbnail").alias("png")), heads)
        self.extracted.replace_documents(extracted, heads)
        self._mark(self._done(heads.select(*KEY, F.col("extractor").alias("version"), F.concat_ws("/", F.lit("pages"), "user_id", "doc_id").alias("output")), "extract"))
        return heads.select("rel_path", F.lit("extracted").alias("status"), F.lit(None).cast("string").alias("detail")).unionByName(failed.select("rel_path", F.lit("error").alias("status"), F.col("error").alias("detail")))

    # stages 3 and 4

    def chunk(self, force: bool = False) -> DataFrame:
        """Clean and cut the extracted documents that are due; (rel_path, status, detail)."""
        c, h = self.settings.cleaning, self.settings.chunking
        rules = {"cleaning": asdict(c), "chunking": asdict(h)}
        documents = self.manifest.read().join(self.extracted.read().select(*KEY, "extractor"), KEY).withColumn("wanted", chunking.chunker_version(rules, F.col("extractor")))
        due = self._to_do(documents, "chunk", self.chunked.read(), force)
        pages = cut(self.pages.read().join(due.select(*KEY), KEY, "left_semi"))
        limits = asdict(c)
        clean = cleaning.cleaned_pages(pages, **limits, columns=("title", "language"))
        subjects = self.spark.createDataFrame([(k, s.name) for k, s in self.settings.subjects.items()], "subject string, name string")
        chunks = cut(chunking.make_chunks(clean, due.withColumn("subject", F.col("metadata.subject")), subjects, h.max_words, h.target_words, h.min_words))
        self.chunks.replace_documents(chunks, due)
        self.removed.replace_documents(cleaning.removed_lines(pages, **limits), due)
        self.chunked.replace_documents(due.select(*KEY, "source", "rel_path", F.col("wanted").alias("chunker")), due)
        self._mark(self._done(due.select(*KEY, F.col("wanted").alias("version"), F.concat_ws("/", F.lit("chunks"), "user_id", "doc_id").alias("output")), "chunk"))
        counts = chunks.groupBy(*KEY).agg(F.count("*").alias("n"))
        return due.join(counts, KEY, "left").select("rel_path", F.lit("chunked").alias("status"), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" chunks")).alias("detail"))

    # stage 5

    def check_model(self) -> None:
        """Refuse to mix vectors of different models in one collection."""
        row = self.collection.read().first()
        if row is None:
            kept = self.spark.createDataFrame([(self.embedder.model, self.embedder.dimension)], "embedding_model string, dimension int")
            self.collection.replace(kept)
        elif (row["embedding_model"], row["dimension"]) != (self.embedder.model, self.embedder.dimension):
            raise StoreError(f"the collection holds vectors of {row['embedding_model']} ({row['dimension']} numbers), not of {self.embedder.model} ({self.embedder.dimension})")

    def index(self, force: bool = False) -> DataFrame:
        """Embed the chunks of the documents that are due and replace their points; (rel_path, status, detail)."""
        self.check_model()
        chunks, points = self.chunks.read(), self.points.read()
        documents = self.manifest.read().join(self.chunked.read().select(*KEY, "chunker"), KEY).withColumn("wanted", F.concat_ws("|", "chunker", F.lit(self.embedder.model)))
        due = self._to_do(documents, "index", vectors.whole_documents(documents, chunks, points), force)
        rows = chunks.join(due.select(*KEY, "source", "rel_path", "metadata"), KEY).withColumn("_text", embedding_text(F.col("header"), F.col("text")))
        new = cut(self.embedder.transform(rows, "_text").drop("_text", "word_count"))
        self.points.replace_documents(new, due)
        counts = new.groupBy(*KEY).agg(F.count("*").alias("n"))
        done = due.join(counts, KEY, "left").select(*KEY, "rel_path", F.col("wanted").alias("version"), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" points")).alias("output"))
        self._mark(self._done(done, "index"))
        return done.select("rel_path", F.lit("indexed").alias("status"), F.col("output").alias("detail"))

    def ingest(self, force: bool = False) -> dict[str, DataFrame]:
        return {"register": self.register(), "extract": self.extract(force), "chunk": self.chunk(force), "index": self.index(force)}

    # reading

    def search(self, question: str, subject: str | None = None, doc_type: str | None = None, k: int = 5, user_id: str | None = None) -> DataFrame:
        """The user's ``k`` nearest chunks, filtered before they are ranked, by their current labels."""
        if subject is not None and subject not in self.settings.subjects:
            raise ConfigError(f"unknown subject {subject!r} (known: {', '.join(sorted(self.settings.subjects))})")
        self.check_model()
        user = user_id or self.settings.user.id
        # the documents are chosen by their current labels, then their points are ranked
        asked = vectors.all_of([F.col(f"metadata.{n}") == v for n, v in (("subject", subject), ("doc_type", doc_type)) if v is not None])
        labels = self.manifest.read().where(vectors.tenant(user) & asked).select(*KEY, F.col("metadata").alias("label"))
        points = self.points.read().where(vectors.tenant(user)).join(labels, KEY).withColumn("metadata", F.col("label")).drop("label")
        hits = vectors.search(points, self.embedder.embed(self.spark, [question])[0], None, k)
        return hits.select("chunk_id", "score", "source", "rel_path", "page", "part", "header", T.snippet(F.col("text")).alias("snippet"), "metadata")

    def inspect(self, query: str, page: int | None = None, chunks: bool = False) -> DataFrame:
        """Pages or chunks of the one document that the query names."""
        found = MF.find(self.manifest.read(), self.settings.user.id, query).limit(31).collect()
        if len(found) != 1:
            names = "\n".join(r["rel_path"] for r in found[:30])
            raise LookupError(f"no document matches {query!r}" if not found else f"{query!r} names several documents:\n{names}")
        rows = MF.get(self.chunks.read() if chunks else self.pages.read(), found[0]["user_id"], found[0]["doc_id"])
        if page is not None:
            rows = rows.where(F.col("page" if chunks else "number") == page)
        return rows.orderBy("chunk_index") if chunks else rows.withColumn("orientation", F.when(F.col("width") > F.col("height"), "landscape").otherwise("portrait")).orderBy("number")

    def count(self, user_id: str, doc_id: str | None = None) -> int:
        return self.points.read().where(vectors.tenant(user_id, doc_id=doc_id)).count()

    def describe_sources(self) -> DataFrame:
        return MF.subject_counts(self.manifest.read())

    def audit(self) -> DataFrame:
        return cleaning.boilerplate_audit(self.removed.read()).orderBy(F.desc("n_documents"), "text")
