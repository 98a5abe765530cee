import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from quire.llm import codepoints as C, encoding, leaks, near_duplicates as N, splitting

CHUNKS = "chunk_id string, text string"


def shingle_set(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return None if len(w) < 30 else set(zip(w, w[1:], w[2:]))


def test_pairs_are_those_of_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for base in range(40):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(28, 90))]
        rows.append((f"{base}-0", " ".join(words)))
        for k in range(rng.randrange(4)):
            edited = list(words)
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(edited))
                edited[at : at + rng.randrange(2)] = [f"x{rng.randrange(9)}"]
            rows.append((f"{base}-{k + 1}", " ".join(edited)))
    rows += [("copy-1", rows[0][1]), ("copy-2", rows[0][1]), ("null", None), ("empty", ""), ("short", "a b c"), ("short-2", "a b c"), ("Ünï", rows[5][1].upper() + " .")]
    sets = {i: s for i, t in rows if t is not None and (s := shingle_set(t))}
    want = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows + rows[:9], CHUNKS).withColumnRenamed("x", "y")
    got = [tuple(r) for r in N.found_chunks(df).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.999 * len(want)
    exact = [tuple(r) for r in N.found_chunks(df, exact=True).collect()]
    assert len(exact) == len(set(exact)) and set(exact) == want
    groups = {r["chunk_id"]: r["group"] for r in N.chunk_groups(df).collect()}
    assert set(groups) == set(sets)
    assert all(groups[a] == groups[b] for a, b in got)
    assert groups["copy-1"] == groups["copy-2"] and len(set(groups.values())) >= 20
    assert N.found_chunks(df.limit(0)).count() == 0 and N.chunk_groups(df.limit(0)).count() == 0


def sets_of_similarity(rng, n, apart):
    a = rng.integers(0, 2**60, n).astype(np.uint64)
    b = a.copy()
    b[:apart] = rng.integers(0, 2**60, apart).astype(np.uint64)
    a, b = np.unique(a), np.unique(b)
    common = len(np.intersect1d(a, b))
    return a, b, common / (len(a) + len(b) - common)


def test_pivots_never_discard_a_pair_in_reach_and_most_others():
    rng = np.random.default_rng(3)
    kept = []
    for _ in range(400):
        n = int(rng.integers(5, 200))
        a, b, t = sets_of_similarity(rng, n, int(rng.integers(0, n + 1)))
        x, y = (N.coordinates(v, np.zeros(len(v), np.int64))[0].astype(int) for v in (a, b))
        # the largest difference over all unions of parts is the sum over the parts
        union = x > y
        assert max(abs(x.sum() - y.sum() - 2 * (x[u].sum() - y[u].sum())) for u in (union, ~union, x == -1)) == np.abs(x - y).sum()
        assert np.abs(x - y).sum() <= (1 - t) / (1 + t) * (len(a) + len(b)) + 1e-9
        if t < 0.4 and n > 30:
            kept.append(np.abs(x - y).sum() <= 0.25 * (len(a) + len(b)))
    assert len(kept) > 50 and np.mean(kept) < 0.05


def test_pairs_do_not_depend_on_how_hot_keys_and_classes_are_split(spark, monkeypatch):
    rng = random.Random(31)
    base = [f"w{rng.randrange(300)}" for _ in range(70)]
    rows = [(f"n{i:02d}", " ".join(base[:-1] + [f"x{i}"])) for i in range(40)] + [(f"c{i:02d}", " ".join(base)) for i in range(30)] + [(f"o{i:02d}", " ".join(f"w{rng.randrange(300)}" for _ in range(50))) for i in range(20)]
    df = spark.createDataFrame(rows, CHUNKS).repartition(5)
    plain = {tuple(r) for r in N.found_chunks(df).collect()}
    monkeypatch.setattr(N, "HOT_CLASSES", 8)
    monkeypatch.setattr(N, "HOT_SAMPLE", 2)
    monkeypatch.setattr(N, "CLASS_SLOT", 7)
    monkeypatch.setattr(N, "COPIES", 4)
    assert N.hot_keys(N.class_texts(df)).count() > 0 and N.thinned(N.class_texts(df)).count() < 90 - 25
    split = [tuple(r) for r in N.found_chunks(df).collect()]
    assert len(split) == len(plain) == 70 * 69 // 2 and set(split) == plain


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    links = [(min(p), max(p)) for p in links if p[0] != p[1]]
    nodes = sorted({x for p in links for x in p} | {500, 501})
    group = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    got = N.components(spark.createDataFrame([(n,) for n in nodes], "class bigint"), spark.createDataFrame(links, "a bigint, b bigint"))
    assert {r["class"]: r["group"] for r in got.collect()} == group


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_subjects(spark):
    rng = random.Random(6)
    names = {"", "a", "abc", "abcd"} | {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14))) for _ in range(120)}
    df = spark.createDataFrame([((n,),) for n in names] + [((None,),), (None,)] + [((n,),) for n in list(names)[:5]], "metadata struct<subject:string>")
    got = {tuple(r) for r in N.found_subjects(df).collect()}
    assert got == {(a, b) for a in names for b in names if a < b and levenshtein(a, b) <= 3}
    assert N.found_subjects(df.limit(0)).count() == 0


WORDY = st.text("ab é.\n\t漢 x", max_size=200)


@given(st.lists(WORDY, max_size=5), st.integers(3, 20), st.integers(8, 60), st.integers(0, 2))
@settings(max_examples=200, deadline=None)
def test_pieces_hold_the_limits_and_all_words(texts, max_words, max_chars, overlap):
    codes, offsets = C.decode(pa.array(texts, pa.string()))
    row, number, a, b, n = splitting.cuts(codes, offsets, max_words, max_chars, overlap)
    over = {i for i, t in enumerate(texts) if len(t.split()) > max_words or len(t) > max_chars and t.split()}
    assert set(row.tolist()) == over
    whole = "".join(texts)
    for i in over:
        mine = [k for k in range(len(row)) if row[k] == i]
        assert number[mine].tolist() == list(range(len(mine)))
        parts = [whole[a[k] : b[k]] for k in mine]
        assert all(len(p) <= max_chars and len(p.split()) <= max_words for p in parts)
        # neighbours meet or overlap: nothing but blanks lies between, and each moves on
        for k, j in zip(mine, mine[1:]):
            assert a[j] > a[k] - 1 and b[j] > b[k] and not whole[b[k] : max(a[j], b[k])].strip()
        assert whole[a[mine[0]] : b[mine[-1]]] == texts[i].strip()


def test_pieces_prefer_natural_boundaries_and_share_words(spark):
    text = "\n\n".join(" ".join(f"w{p}x{k}" for k in range(100)) + "." for p in range(12))
    chunks = spark.createDataFrame([("u", "d", 1, 0, text), ("u", "d", 1, 0, text), ("u", "d", 2, 0, None), ("u", "d", 3, 0, "x" * 9000), ("u", "e", 1, 0, "ok " * 450), ("u", "e", 2, 0, "ok " * 451)], "user_id string, doc_id string, page int, part int, text string")
    pages = spark.createDataFrame([], "user_id string, doc_id string, number int, text string")
    rows = splitting.pieces(splitting.items(pages, chunks)).orderBy("doc_id", "page", "piece").collect()
    mine = [r["text"].split() for r in rows if (r["doc_id"], r["page"]) == ("d", 1)]
    assert len(mine) > 2 and all(m[-1].endswith(".") for m in mine) and all(x[-40:] == y[:40] for x, y in zip(mine, mine[1:]))
    assert [r["n_chars"] for r in rows if r["page"] == 3] == [4000, 4000, 1000]
    found = {tuple(r) for r in splitting.found_items(pages, chunks).collect()}
    assert found == {("chunk", "u", "d", 1, 0), ("chunk", "u", "d", 3, 0), ("chunk", "u", "e", 2, 0)}


ENCODABLE = st.text(max_size=200) | st.text("a bé\n'  <|endoftext|>1漢\x85 ", max_size=200)


@given(st.lists(st.one_of(st.none(), ENCODABLE), max_size=6))
@settings(max_examples=150, deadline=None)
def test_ids_are_those_of_encoding_each_text_alone(texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    tokenizer = encoding.encoder("byte_bpe_50k", encoding.TOKENIZERS)
    want = [tokenizer.encode_ordinary(t) if t else [] for t in texts]
    codes, offsets = C.decode(pa.array(texts, pa.string()))
    for anywhere in (False, True):
        dictionary = encoding.ChunkDictionary(tokenizer)
        for _ in range(2):
            ids, total = dictionary.ids(codes, offsets, encoding.cut_places(codes, offsets, np.uint64(1), anywhere))
            assert [ids[a:b].tolist() for a, b in zip(total, total[1:])] == want


def test_unsafe_cuts_are_found_and_repaired():
    tokenizer = encoding.encoder("byte_bpe_50k", encoding.TOKENIZERS)
    texts = ["semaphores and interrupts share the system bus of every node", "plain"]
    codes, offsets = C.decode(pa.array(texts, pa.string()))
    dictionary = encoding.ChunkDictionary(tokenizer)
    inside = np.arange(1, 10)
    bad = inside[~dictionary.agreeing(codes, offsets, inside)]
    assert len(bad)
    starts = np.array([0, bad[0], 30, 33, int(offsets[1])])
    ids, total = dictionary.ids(codes, offsets, starts)
    assert [ids[a:b].tolist() for a, b in zip(total, total[1:])] == [tokenizer.encode_ordinary(t) for t in texts]


def test_joins_are_repaired_until_they_agree():
    encode = encoding.encoder("byte_bpe_50k", encoding.TOKENIZERS).encode_ordinary
    text = "semaphores and interrupts share the bus"
    for cut in range(1, len(text)):
        assert encoding.repaired([text[:cut], text[cut:]], encode) == encode(text)


def test_token_query_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, None), (3, ""), (4, "x" * 5000)], "doc_id bigint, text string")
    rows = encoding.token_ids(df).collect()
    assert len(rows) == 5 and {r["doc_id"]: r["ids"] for r in rows}[2] == [] and {r["doc_id"]: r["ids"] for r in rows}[3] == []
    assert encoding.token_ids(df.limit(0)).count() == 0


def words_of(text):
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return re.findall(r"[^\W_]+", "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Me")))


def test_leaks_are_those_of_brute_force(spark):
    rng = random.Random(12)
    items = [(i, " ".join(rng.choice("the bus of data checks a page é ÀB x1").upper() if False else rng.choice(["the", "bus", "of", "data", "Checks", "pàge", "é", "x1"]) for _ in range(rng.randrange(5, 40)))) for i in range(12)] + [(90, None), (91, ""), (92, "too few words")]
    documents = []
    for d in range(120):
        words = [rng.choice(["the", "bus", "of", "other", "data", "zz"]) for _ in range(rng.randrange(0, 60))]
        if d % 3 == 0:
            source = (items[rng.randrange(12)][1]).split()
            at = rng.randrange(len(source))
            words += [rng.choice((w, w.upper(), unicodedata.normalize("NFD", w))) for w in source[at : at + rng.randrange(8, 30)]]
        documents.append((d, rng.choice((" ", ", ", "\n")).join(words)))
    documents += [(500, None), (501, "")]
    phrases = {}
    for i, t in items:
        w = words_of(t or "")
        for k in range(len(w) - 11):
            phrases.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for d, t in documents:
        w = words_of(t or "")
        for k in range(len(w) - 11):
            want |= {(d, i) for i in phrases.get(tuple(w[k : k + 12]), ())}
    docs = spark.createDataFrame(documents + documents[:10], "doc_id bigint, text string")
    tests = spark.createDataFrame(items + items[:3], "item_id bigint, text string")
    got = [tuple(r) for r in leaks.found_leaks(docs, tests).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want
    texts = dict(documents)
    for r in leaks.spans(docs, tests).collect():
        part = words_of(texts[r["doc_id"]][r["first"] : r["last"]])
        assert len(part) >= 12 and all(r["item_id"] in phrases[tuple(part[k : k + 12])] for k in range(len(part) - 11))
    whole = leaks.MAX_ITEM_WORDS
    leaks.MAX_ITEM_WORDS = 300
    try:
        assert len(leaks.item_parts(tests)) > 1
        assert {tuple(r) for r in leaks.found_leaks(docs, tests).collect()} == want
    finally:
        leaks.MAX_ITEM_WORDS = whole
    merged = leaks.removal_spans(docs, tests).collect()
    assert {r["doc_id"] for r in merged} == {d for d, _ in want}
    assert leaks.found_leaks(docs.limit(0), tests).count() == 0 and leaks.found_leaks(docs, tests.limit(0)).count() == 0


@given(st.lists(st.integers(1, 4), max_size=80))
@settings(max_examples=100, deadline=None)
def test_index_counts_and_locates(sequence):
    index = leaks.FMIndex(np.array(sequence, np.int64), 5)
    for phrase in ([1], [2, 3], [1, 1, 1], [4, 2]):
        low, high = index.search(np.array([phrase]))
        at = sorted(index.positions(np.arange(low[0], high[0])).tolist())
        assert at == [i for i in range(len(sequence) - len(phrase) + 1) if sequence[i : i + len(phrase)] == phrase]


def test_a_group_of_copies_that_holds_a_third_of_the_rows(spark):
    rng = random.Random(21)
    hot = " ".join(f"w{rng.randrange(300)}" for _ in range(60))
    rows = [(f"h{i:03d}", hot) for i in range(60)] + [(f"o{i:03d}", " ".join(f"w{rng.randrange(300)}" for _ in range(60))) for i in range(120)] + [("near", hot + " one more word")]
    df = spark.createDataFrame(rows, CHUNKS).repartition(6)
    groups = {r["chunk_id"]: (r["group"], r["n_links"]) for r in N.chunk_groups(df).collect()}
    assert len(groups) == 181 and len({groups[k] for k in groups if k[0] == "h"}) == 1
    assert groups["near"][0] == groups["h000"][0] and groups["near"][1] == groups["h000"][1] == 1
    assert len({groups[k][0] for k in groups if k[0] == "o"}) == 120
    assert N.band_keys(N.class_texts(df)).count() <= N.BANDS * (121 + 6)  # copies inside a block are dropped before the bands
    assert N.found_chunks(df).count() == 61 * 60 // 2


def test_extra_columns_with_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([("a", text, 1, 1, "x"), ("b", text, 2, 2, "y")], "chunk_id string, text string, class int, key int, a string")
    assert [tuple(r) for r in N.found_chunks(df).collect()] == [("a", "b")]
    docs = spark.createDataFrame([(1, "some text", 5, 6)], "doc_id bigint, text string, ids int, first int")
    assert encoding.token_ids(docs).columns == ["doc_id", "ids"]
    items = spark.createDataFrame([(1, text, 9)], "item_id bigint, text string, doc_id int")
    assert leaks.found_leaks(docs.withColumnRenamed("ids", "item_id"), items).count() == 0


def test_blank_texts_over_the_character_limit_have_one_empty_piece(spark):
    chunks = spark.createDataFrame([("u", "d", 1, 0, " " * 4001), ("u", "d", 1, 0, " " * 4001), ("u", "d", 2, 0, "\n " * 2000), ("u", "d", 3, 0, "word " * 500)], "user_id string, doc_id string, page int, part int, text string")
    pages = spark.createDataFrame([("u", "d", 9, "\n " * 3000)], "user_id string, doc_id string, number int, text string")
    found = {tuple(r) for r in splitting.found_items(pages, chunks).collect()}
    assert found == {("page", "u", "d", 9, -1), ("chunk", "u", "d", 1, 0), ("chunk", "u", "d", 3, 0)}
    rows = splitting.pieces(splitting.items(pages, chunks)).where("n_words = 0").collect()
    assert sorted((r["kind"], r["page"], r["piece"], r["n_chars"], r["text"]) for r in rows) == [("chunk", 1, 0, 0, ""), ("page", 9, 0, 0, "")]
