import pytest
from pyspark.sql import functions as F

from quire.functions.language import TrigramModel, trigram_counts
from quire.functions.stages import checked_join
from quire.functions.tables import latest_rows, salted_join
from quire.operators import extracting, manifest as MF, registering, vectors

FILES = "user_id string, source string, rel_path string, doc_id string, size_bytes bigint, metadata struct<subject:string>, error string"
OLD = "user_id string, doc_id string, source string, rel_path string, size_bytes bigint, metadata struct<subject:string>, registered_at timestamp, updated_at timestamp"


def test_register_statuses(spark):
    m = lambda s: {"subject": s}
    files = spark.createDataFrame([("u", "a", p, d, 1, m("s"), e) for p, d, e in [("new", "n", None), ("a-b/c", "dup", None), ("a/b", "dup", None), ("same", "same", None), ("there", "moved", None), ("lab", "label", None), ("bad", "bad", "wrong folder"), ("x", "other", None), ("y", "left", None)]] + [("u", "b", "keep", "other", 1, m("s"), None)], FILES)
    old = spark.createDataFrame([("u", d, s, p, 1, m(x), None, None) for d, s, p, x in [("same", "a", "same", "s"), ("moved", "a", "here", "s"), ("label", "a", "lab", "t"), ("bad", "a", "bad", "s"), ("gone", "a", "gone", "s"), ("other", "b", "keep", "s"), ("left", "b", "was", "s")]], OLD)
    statuses = registering.register(files, old)
    got = sorted((r["source"], r["rel_path"], r["status"], r["detail"] or "") for r in statuses.collect())
    assert got == sorted(
        [
            ("a", "new", "new", ""), ("a", "a/b", "new", ""), ("a", "a-b/c", "duplicate", "a/b"), ("a", "same", "unchanged", ""), ("a", "there", "moved", "here"), ("a", "lab", "moved", "lab"),
            ("a", "bad", "error", "wrong folder"), ("a", "bad", "missing", ""), ("a", "x", "duplicate", "b/keep"), ("a", "y", "moved", "was"), ("b", "keep", "unchanged", ""), ("a", "gone", "missing", ""), ("b", "was", "missing", ""),
        ]
    )
    after = registering.apply_statuses(old, files, statuses, F.to_timestamp(F.lit("2026-01-01")))
    paths = {r["doc_id"]: (r["source"], r["rel_path"]) for r in after.collect()}
    assert paths["moved"] == ("a", "there") and paths["left"] == ("a", "y") and paths["dup"] == ("a", "a/b") and paths["other"] == ("b", "keep")
    assert {r["doc_id"] for r in after.collect()} == {"same", "moved", "label", "bad", "gone", "other", "left", "n", "dup"}


def test_manifest_operations(spark):
    rows = spark.createDataFrame([("u", "abc", "s", "Dir/50%_x.pdf", 1, None, None, None), ("v", "abd", "s", "q", 1, None, None, None)], OLD)
    assert MF.find(rows, "u", "50%_").count() == 1 and MF.find(rows, "u", "5__").count() == 0 and MF.find(rows, "u", "dir").count() == 1 and MF.find(rows, "u", "AB").count() == 1
    assert MF.get(rows, "u", "abd").count() == 0 and MF.documents(rows, "u", "s").count() == 1
    with pytest.raises(ValueError):
        MF.add(rows, rows.limit(1))
    assert MF.add(rows, rows.limit(1).withColumn("doc_id", F.lit("z"))).count() == 3
    moved = MF.update_location(rows, rows.where("user_id = 'u'").withColumn("rel_path", F.lit("p2")), F.current_timestamp())
    assert {r["doc_id"]: (r["rel_path"], r["updated_at"] is None) for r in moved.collect()} == {"abc": ("p2", False), "abd": ("q", True)}
    stages = spark.createDataFrame([("u", "abc", "extract", "1", "o", None)], "user_id string, doc_id string, stage string, version string, output string, completed_at timestamp")
    assert MF.mark_done(stages, stages.withColumn("version", F.lit("2"))).first()["version"] == "2"
    assert MF.stage(stages, "u", "abc", "chunk").count() == 0 and MF.prune(rows, rows.limit(1)).count() == 1
    gate = MF.stage_gate(rows, stages, "extract", F.lit("1"), rows.limit(0))
    assert {r["status"] for r in gate.collect()} == {"to_do"}


def test_latest_rows_and_joins(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "c"), ("l", None, "d")], "k string, t int, v string")
    assert {r["k"]: r["v"] for r in latest_rows(df, ["k"], ["t"]).collect()} == {"k": "c", "l": "d"}
    big = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(0, "x"), (1, "y"), (None, "n")], "k bigint, name string")
    for how in ("inner", "left"):
        plain = sorted(map(str, big.join(small, "k", how).collect()))
        assert sorted(map(str, salted_join(big, small, ["k"], 4, how).select("k", "v", "name").collect())) == plain
        assert sorted(map(str, checked_join(big, small, ["k"], how).select("k", "v", "name").collect())) == plain
        assert sorted(map(str, checked_join(big, small, ["k"], how, most=1).select("k", "v", "name").collect())) == plain


def test_titles(spark):
    rows = [("d", 0, " Big ", 20.0, 10.0), ("d", 1, "title", 19.6, 20.0), ("d", 2, "body text that is long", 10.0, 300.0), ("e", 0, "flat", 10.0, 10.0), ("e", 1, "flat body", 10.0, 400.0), ("f", 0, "• • •", 30.0, 5.0), ("f", 1, "body", 10.0, 300.0), ("g", 0, "  ", 30.0, 5.0), ("g", 1, "low big", 30.0, 700.0), ("g", 2, "x" * 30, 10.0, 10.0)]
    spans = spark.createDataFrame(rows, "k string, ord int, text string, size double, top double").withColumn("page_height", F.lit(800.0))
    assert {r["k"]: r["title"] for r in extracting.guess_titles(spans, ["k"]).collect()} == {"d": "Big title", "e": None, "f": None, "g": None}


def test_page_languages_and_facts(spark, make_pages):
    pages = make_pages(["a", None, "b", "c"])
    pages = pages.withColumn("language", F.expr("case number when 1 then 'es' when 3 then 'ca' when 4 then 'ca' end"))
    assert extracting.document_languages(pages.unionByName(pages)).first()["languages"] == ["ca", "es"]
    facts = {r["number"]: (r["char_count"], r["empty"]) for r in extracting.page_facts(pages.unionByName(pages)).collect()}
    assert facts == {1: (1, False), 2: (0, True), 3: (1, False), 4: (1, False)}


def test_search_filters_before_it_ranks(spark):
    rows = spark.createDataFrame([("u", "a", [1.0, 0.0]), ("u", "b", [1.0, 0.1]), ("v", "c", [1.0, 0.0]), ("u", "z", [0.0, 0.0]), ("u", "n", None), ("u", "a2", [2.0, 0.0])], "user_id string, chunk_id string, embedding array<float>")
    hits = vectors.search(rows, [1.0, 0.0], vectors.tenant("u"), 3).collect()
    assert [h["chunk_id"] for h in hits] == ["a", "a2", "b"]
    assert vectors.search(rows, [1.0, 0.0], vectors.tenant("v", chunk_id="x")).count() == 0
    assert vectors.search(rows.limit(0), [1.0, 0.0]).count() == 0


def test_search_all_is_brute_force_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.integers(-2, 3, 4)] if i % 17 else [0.0] * 4) for i in range(150)] + [(150, None)]
    rows = spark.createDataFrame(data, "vec_id bigint, embedding array<float>").repartition(5)
    for block in (7, 4096):
        got = {}
        for r in vectors.search_all(rows, rows.where("vec_id % 10 = 0"), k=4, block=block).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], round(r["score"], 9))
        unit = {i: np.array(v) / np.linalg.norm(v) for i, v in data if v and any(v)}
        want = {q: {n + 1: (i, round(s, 9)) for n, (s, i) in enumerate(sorted(((round(float(unit[q] @ u), 9), i) for i, u in unit.items()), key=lambda x: (-x[0], x[1]))[:4])} for q in unit if q % 10 == 0}
        assert got == want
    assert vectors.search_all(rows, rows.limit(0)).count() == 0
    few = rows.where("vec_id between 1 and 2")
    assert vectors.search_all(few, few, k=5).count() == 4 and vectors.search_all(few.limit(0), few).count() == 0


def test_hash_embedding(spark):
    import re
    import zlib

    df = spark.createDataFrame([("One two TWO é_1",), ("",), (None,)], "text string")
    got = [r["embedding"] for r in vectors.hash_embedding(df, dimension=8).collect()]
    want = [1e-6] + [0.0] * 7
    for w in re.findall(r"\w+", "one two two é_1"):
        want[zlib.crc32(w.encode()) % 8] += 1
    assert got[0] == pytest.approx(want) and got[1] == got[2] == pytest.approx([1e-6] + [0.0] * 7)
    assert df.columns == ["text"]


def test_points_are_replaced_by_document(spark):
    points = spark.createDataFrame([("u", "a", "1"), ("u", "a", "2"), ("u", "b", "3"), ("v", "a", "4")], "user_id string, doc_id string, chunk_id string")
    new = spark.createDataFrame([("u", "a", "2"), ("u", "a", "9")], points.schema)
    assert sorted(r["chunk_id"] for r in vectors.replace_documents(points, new, new).collect()) == ["2", "3", "4", "9"]
    assert [r["chunk_id"] for r in vectors.stale_points(points, new).collect()] == ["1"]
    emptied = vectors.replace_documents(points, new.limit(0), new)
    assert sorted(r["chunk_id"] for r in emptied.collect()) == ["3", "4"]


def test_retrieval_quality(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1), (2, 13, 2)], "query_id int, item int, rank int")
    truth = spark.createDataFrame([(1, 11), (2, 12), (3, 1)], "query_id int, item int")
    assert tuple(vectors.retrieval_quality(ranked, truth).first()) == (3, 0.666667, 0.5)


def test_trigram_model(spark):
    texts = [("the cat sat on the mat with the other cat", "en"), ("el gato se sienta en la alfombra con el otro gato", "es")]
    model = TrigramModel(trigram_counts(spark.createDataFrame(texts, "t string, l string"), "t", "l"), ("en", "es"))
    assert model.detect("the other cat sat with the mat") == "en" and model.detect("el otro gato en la alfombra") == "es"
    assert model.detect("the cat") is None and model.detect(None) is None and model.detect("zzzz qqqq wwww xxxx kkkk") is None


def test_listing_totals_and_whole_documents(spark):
    rows = spark.createDataFrame([("u", "b", "s", "z"), ("u", "a", "s", "z"), ("u", "c", "r", None), ("v", "a", "s", "q")], "user_id string, doc_id string, source string, rel_path string").withColumn("place", F.lit("clash"))
    assert {(r["user_id"], r["doc_id"]): r["place"] for r in MF.listed(rows).collect()} == {("u", "c"): 1, ("u", "a"): 2, ("u", "b"): 3, ("v", "a"): 1}
    stages = spark.createDataFrame([("u", "a", "chunk", "1"), ("u", "b", "chunk", "1"), ("u", "a", "index", None)], "user_id string, doc_id string, stage string, version string")
    assert {tuple(r) for r in MF.stage_totals(stages).collect()} == {("chunk", "1", 2), ("index", None, 1)}
    keys = rows.select("user_id", "doc_id")
    chunks = spark.createDataFrame([("u", "a"), ("u", "a"), ("u", "b")], "user_id string, doc_id string")
    points = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "a")], "user_id string, doc_id string")
    assert {tuple(r) for r in vectors.whole_documents(keys, chunks, points).collect()} == {("u", "b"), ("u", "c")}
    assert MF.listed(rows.limit(0)).count() == 0 and vectors.whole_documents(keys.limit(0), chunks, points).count() == 0


def test_slugs_and_years(spark):
    from quire.functions import metadata as M

    df = spark.createDataFrame([("a_b1",), ("A b",), ("",), (None,), ("2024-25",), ("2024-26",)], "t string")
    assert [r[0] for r in df.select(M.is_slug(F.col("t"))).collect()] == [True, False, False, None, False, False]
    assert [r[0] for r in df.select(M.is_academic_year(F.col("t"))).collect()] == [False, False, False, None, True, False]


def test_detection_is_the_same_in_any_batching(spark):
    import pyarrow as pa

    texts = [("the cat sat on the mat with the other cat", "en"), ("el gato se sienta en la alfombra con el otro gato", "es")]
    model = TrigramModel(trigram_counts(spark.createDataFrame([*texts, (None, "en"), ("x", None), ("", "es")], "t string, l string"), "t", "l"), ("en", "es"))
    many = [texts[i % 2][0] * (i % 5 + 1) if i % 7 else None for i in range(60)] + ["", "İİ", "漢字" * 20]
    together = model.detect_all(pa.array(many, pa.string())).to_pylist()
    assert together == [model.detect(t) for t in many] and together[1] == "es"
    empty = TrigramModel(trigram_counts(spark.createDataFrame([], "t string, l string"), "t", "l"), ("en", "es"))
    assert empty.detect("the cat sat on the mat again") is None and empty.detect_all(pa.array([], pa.string())).to_pylist() == []
