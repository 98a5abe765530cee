import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from quire.llm import codepoints as C, lookalikes, repeated_lines

TEXTS = st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("aàé́ ﬁ​\n\t ＡжЖаеoxѕ1９²º", max_size=30)), max_size=8)


def normal(texts):
    codes, offsets, found = lookalikes.normalise(*C.decode(pa.array(texts, pa.string())))
    return C.encode(codes, offsets, np.array([t is None for t in texts], bool)).to_pylist(), found.tolist()


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_arrow_and_code_points_go_round(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    codes, offsets = C.decode(pa.array(texts, pa.string()))
    assert C.encode(codes, offsets).to_pylist() == [t or "" for t in texts]
    sliced = pa.array(["x", *texts, "yé"], pa.string()).slice(1, len(texts))
    again, _ = C.decode(sliced)
    assert again.tolist() == codes.tolist()


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_normal_form_is_stable_and_row_by_row(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    once, _ = normal(texts)
    twice, found = normal(once)
    assert twice == once and not any(found)
    assert once == [normal([t])[0][0] for t in texts]


def test_bytes_that_are_no_text():
    broken = pa.Array.from_buffers(pa.string(), 2, pa.array([b"ok", b"a\xffb"]).buffers())
    codes, offsets = C.decode(broken)
    assert C.encode(codes, offsets).to_pylist() == ["ok", "a\ufffdb"]


def test_disguises_and_what_is_none():
    cases = {
        "a\u0301": "\u00e1", "a\u200bb": "ab", "w\u0456t\u04bb": "with", "\uff21\uff22\uff43\uff11": "ABc1", "\ufb01x": "fix", "co\u0140lecci\u00f3": "col\u00b7lecci\u00f3", "a\u00a0b": "a b", "soft\u00adhyphen": "softhyphen", "x\u2011y": "x-y",
        "\U0001d421\U0001d422 \U0001d465": "hi \U0001d465", "o\u0323\u0301": "\u1ecd\u0301", "\u0441af\u0435\u0301": "caf\u00e9", "\ufeffx": "x", "a\u2028b": "a b", "\r\n": "\n",
    }
    got, found = normal(list(cases))
    assert got == list(cases.values())
    assert all(found)
    plain = ["граф", "привет, мир", "λ = 5, σ² ≤ Σ xᵢ²", "n.º 3ª", "• – — « » ★ “x”", "Δt", "a\tb\nc d", "", "\u03b5\u03bb\u03bb\u03b7\u03bd\u03b9\u03ba\u03ac", "\u0645\u06cc\u200c\u062e\u0648\u0627\u0647\u0645"]
    assert normal(plain) == (plain, [False] * len(plain))


def test_found_fields_and_rewrite(spark):
    rows = [("u", "d", 1, "tі", None, 7), ("u", "d", 1, "tі", None, 7), ("u", "d", 2, "plain", "a​", 8), (None, None, None, None, "x ", None), ("u", "e", 3, "", "", 1)]
    pages = spark.createDataFrame(rows, "user_id string, doc_id string, number int, title string, text string, found int")
    got = {tuple(r) for r in lookalikes.found_fields(pages).collect()}
    assert got == {("u", "d", 1, "title"), ("u", "d", 2, "text"), (None, None, None, "text")}
    assert lookalikes.found_fields(pages).count() == 3 and lookalikes.found_fields(pages.limit(0)).count() == 0
    same = lookalikes.normalised(pages, "title", "text")
    assert same.columns == pages.columns and {(r["title"], r["text"]) for r in same.collect()} == {("ti", None), ("plain", "a"), (None, "x "), ("", "")}
    groups = lookalikes.value_groups(spark.createDataFrame([("u", "d", 1, "ti", None), ("u", "d", 2, "tі", None)], "user_id string, doc_id string, number int, title string, text string"))
    assert [(r["field"], r["n_spellings"], r["n_rows"]) for r in groups.collect()] == [("title", 2, 2)]


def brute_places(pages, sources, share, least, letters):
    docs, places = {}, {}
    for u, d, n, t in pages:
        if t is None or (u, d) not in sources:
            continue
        for i, line in enumerate(normal([t])[0][0].split("\n"), 1):
            key = re.sub(r"\d+", "0", re.sub(r"\s+", "", line.lower()))
            if sum(c.isalpha() for c in key) >= letters:
                docs.setdefault((sources[u, d], key), set()).add((u, d))
                places.setdefault((sources[u, d], key), set()).add((u, d, n, i))
    sizes = {}
    for s in sources.values():
        sizes[s] = sizes.get(s, 0) + 1
    return set().union(*[places[k] for k, v in docs.items() if len(v) >= least and len(v) >= share * sizes[k[0]]], set())


def test_frequent_lines_are_those_of_brute_force(spark):
    rng = random.Random(2)
    lines = ["Legal notice number 12", "LEGAL NOTICE number 99", "Lеgal  notice number 3", "short", "shared by the whole class", "rarely seen line here", "", "é" * 12, "é" * 12]
    pages, manifest = [], []
    for d in range(60):
        source = "hot" if d % 3 else "cold"
        manifest += [("u", f"d{d}", source, d)] * rng.choice((1, 2))
        if d % 9 == 0:
            manifest.append(("u", f"d{d}", "cold", 1000))
        for n in range(1, 3):
            text = "\n".join(rng.choice(lines) if rng.random() < 0.5 else f"own text {d} {n} " + "".join(rng.choice("abcdef") for _ in range(9)) for _ in range(4))
            pages += [("u", f"d{d}", n, rng.choice((text, text, None)))] * rng.choice((1, 2))
    pages += [("v", "stranger", 1, "Legal notice number 12"), ("u", "d0", 9, "")]
    # repeated rows are exact: one text for each page
    pages = list({p[:3]: p for p in pages}.values()) + pages[:0]
    sources = {}
    for u, d, s, at in sorted(manifest, key=lambda m: m[3]):
        sources[u, d] = s
    p = spark.createDataFrame(pages + pages[:20], "user_id string, doc_id string, number int, text string")
    m = spark.createDataFrame(manifest, "user_id string, doc_id string, source string, updated_at int")
    for share, least in ((0.15, 6), (0.4, 2), (0.05, 1)):
        got = repeated_lines.found_places(p, m, min_share=share, min_documents=least)
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == brute_places(pages, sources, share, least, 10)
    cleaned = {(r["doc_id"], r["number"]): (r["text"], r["n_removed"]) for r in repeated_lines.cleaned_pages(p, m).collect()}
    places = brute_places(pages, sources, 0.15, 6, 10)
    assert len(cleaned) == len(pages)
    for u, d, n, t in pages:
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n"), 1) if (u, d, n, i) not in places)
        assert cleaned[d, n][0] == kept
    assert repeated_lines.found_places(p.limit(0), m).count() == 0 and repeated_lines.found_places(p, m.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_blocks_hold_every_row_once(n):
    batch = pa.RecordBatch.from_pydict({"t": pa.array(["x" * (i % 50) if i % 7 else None for i in range(n)], pa.string()), "i": pa.array(range(n), pa.int64())})
    parts = list(C.blocks([batch], "t", limit=100))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(n))


def test_unicode_data_is_what_the_tables_say():
    table = C.classes()
    for code in C.tabulated():
        assert bool(table[code] & C.LETTER) == (unicodedata.category(chr(code))[0] == "L")
        if code > 0x3400:
            break


def test_letters_in_the_holes_of_the_mathematical_alphabets():
    texts = ["𝑡ℎ𝑒", "𝒽ℯ𝓁𝓁ℴ", "ℂℝ", "ℎ = 2", "ℝ", "ℏω", "№ ℃ ⅀"]
    assert normal(texts) == (["the", "hello", "CR", "ℎ = 2", "ℝ", "ħω", "№ ℃ ⅀"], [True, True, True, False, False, True, False])


CANONICAL = st.text("aeoươâêẹậḜ̣̱́̂̈̕ͅ한고하한각োୈבְּ z\n", max_size=14)


@given(st.lists(CANONICAL, min_size=1, max_size=6))
@settings(max_examples=500, deadline=None)
def test_marks_and_jamo_come_in_canonical_form(texts):
    got, found = normal(texts)
    want = [unicodedata.normalize("NFC", t) for t in texts]
    assert got == want and found == [a != b for a, b in zip(texts, want)]


def test_every_composed_letter_comes_back_from_its_parts():
    letters = [c for c in map(chr, [*C.tabulated(), *range(0xAC00, 0xD7A4, 7)]) if unicodedata.normalize("NFC", c) == c != unicodedata.normalize("NFD", c)]
    # letters that other rules of the normal form touch are left out
    letters = [c for c, same in zip(letters, normal(letters)[0]) if same == c and unicodedata.normalize("NFKD", c) == unicodedata.normalize("NFD", c)]
    assert len(letters) > 1500 and normal([unicodedata.normalize("NFD", c) for c in letters])[0] == letters


def test_more_lookalikes_inside_latin_words():
    assert normal(["ɴice", "Ьest", "ꓢale", "woгd", "ꮪale"]) == (["Nice", "best", "Sale", "word", "sale"], [True] * 5)
