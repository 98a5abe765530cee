import random
import uuid

from pyspark.sql import functions as F

from quire.operators import chunking, cleaning


def clean(pages):
    return [r["text"] for r in cleaning.cleaned_pages(pages).orderBy("number").collect()]


def test_footer_goes_and_is_counted(make_pages):
    pages = make_pages(["Course  X\nbody one\n1", "course x\nbody two\n2", "COURSE X\nbody three\n3", "body four\n4"])
    assert clean(pages) == ["body one", "body two", "body three", "body four"]
    removed = {r["text"]: r["n_removed"] for r in cleaning.removed_lines(pages).collect()}
    assert removed == {"Course X": 3, cleaning.PAGE_NUMBER: 4}


def test_short_documents_keep_lines_but_lose_numbers(make_pages):
    assert clean(make_pages(["foot\nx\n1", "foot\ny\n2"])) == ["foot\nx", "foot\ny"]


def test_numbers_go_only_at_the_edges_and_near_the_page(make_pages):
    texts = ["a\n7\nb", "2\nb", "1\nc", "4\nd", "2\ne", "0\nf", "9\ng"]
    assert clean(make_pages(texts)) == ["a\n7\nb", "b", "c", "d", "2\ne", "0\nf", "9\ng"]


def test_a_number_above_a_removed_footer_is_no_edge(make_pages):
    texts = [f"t{i}\n{i}\nfooter" for i in range(1, 5)]
    assert clean(make_pages(texts)) == [f"t{i}\n{i}" for i in range(1, 5)]


def test_repeated_numbers_and_long_lines_are_data(make_pages):
    long = "x" * 101
    assert clean(make_pages([f"{long}\n55\nz{i}" for i in range(4)])) == [f"{long}\n55\nz{i}" for i in range(4)]


def test_null_empty_repeated_pages_and_empty_tables(spark, make_pages):
    pages = make_pages([None, "", "a\n\n\n\nb"])
    assert clean(pages.unionByName(pages)) == ["", "", "a\n\nb"]
    assert clean(pages.limit(0)) == [] and cleaning.removed_lines(pages.limit(0)).count() == 0
    assert cleaning.boilerplate_audit(cleaning.removed_lines(pages)).count() == 0


def test_extra_columns_do_not_clash(make_pages):
    pages = make_pages(["a\n1", "b\n2"]).withColumn("place", F.lit(9)).withColumn("key", F.lit("k")).withColumn("line", F.lit(1))
    assert clean(pages) == ["a", "b"]


def pieces(spark, texts, *limits):
    """The chunks of each text, by its place."""
    pages = spark.createDataFrame(list(enumerate(texts)), "number int, text string")
    found = {}
    for r in chunking.split_pages(pages, *limits).orderBy("number", "part").collect():
        found.setdefault(r["number"], []).append(r["text"])
        assert r["part"] == len(found[r["number"]]) - 1
    return [found.get(i, []) for i in range(len(texts))]


def test_packing_keeps_all_words_in_order_and_the_limits(spark):
    rng = random.Random(3)
    block = lambda: "\n".join(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 4)))
    texts = ["\n\n".join(block() for _ in range(rng.randrange(1, 12))) for _ in range(200)]
    for text, parts in zip(texts, pieces(spark, texts, 50, 40, 1)):
        sizes = [len(p.split()) for p in parts]
        assert " ".join(parts).split() == text.split() and max(sizes) <= 50
        if len(parts) > 1:
            assert sizes[-1] >= 10 or sum(sizes[-2:]) > 50
        # a chunk under the target stays open as long as the next unit has room: two neighbours never fit together, but for the last
        assert all(a >= 40 or a + b > 40 for a, b in zip(sizes, sizes[1:-1]))


def test_cases_of_packing(spark):
    texts = [" a\nb \n\n c ", " \n", None, " ".join(["w"] * 25), "a b c d e f\n\ng h\n \u00a0\ni", "one two three four five six\nseven eight nine ten eleven"]
    got = pieces(spark, texts, 10, 8, 1)
    assert got[0] == ["a\nb \n\n c"] and got[1] == got[2] == [] and [len(p.split()) for p in got[3]] == [10, 10, 5]
    assert got[4] == ["a b c d e f\n\ng h\n \u00a0\ni"]
    assert got[5] == ["one two three four five six", "seven eight nine ten eleven"]
    assert pieces(spark, texts[4:5], 8, 4, 1) == [["a b c d e f", "g h\n\ni"]] and pieces(spark, ["a b"], 10, 8, 3) == [[]]
    # a small rest joins the chunk before it
    assert [len(p.split()) for p in pieces(spark, ["\n\n".join(["w " * 8, "w " * 8, "w"])], 10, 8, 1)[0]] == [8, 9]


def test_ids_are_version_5_uuids_of_their_names(spark):
    names = ["", "u|d|0|text", "ü€ 漢"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(chunking.uuid5(F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(chunking.NAMESPACE, n)) for n in names]


def test_chunks_have_headers_places_and_ids(spark, make_pages):
    pages = make_pages(["word " * 500, "tiny", "five words are enough here", None]).select("user_id", "doc_id", "number", "title", "text", "language")
    documents = spark.createDataFrame([("u", "d", "s/theory/my_file-1.v2.pdf", "s")], "user_id string, doc_id string, rel_path string, subject string")
    subjects = spark.createDataFrame([("s", "Subject")], "subject string, name string")
    rows = chunking.make_chunks(pages, documents, subjects).orderBy("chunk_index").collect()
    assert [(r["page"], r["part"], r["chunk_index"], r["word_count"]) for r in rows] == [(1, 0, 0, 450), (1, 1, 1, 50), (3, 0, 2, 5)]
    assert rows[0]["header"] == "Subject · my file 1.v2 · p. 1" and len({r["chunk_id"] for r in rows}) == 3
    unknown = chunking.make_chunks(pages, documents.withColumn("subject", F.lit(None).cast("string")), subjects).first()
    assert unknown["header"].startswith("my file")


def test_the_version_follows_the_settings(spark):
    versions = [spark.range(1).select(chunking.chunker_version(x, F.lit("x-1"))).first()[0] for x in ({"max": 1, "a": 2}, {"a": 2, "max": 1}, {"max": 2, "a": 2})]
    assert versions[0] == versions[1] != versions[2] and versions[0].startswith("chunker-1:") and versions[0].endswith(":x-1")
