import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire.operators import incremental

T0 = dt.datetime(2026, 1, 1)
STAGES = "user_id string, doc_id string, stage string, version string, output string, completed_at timestamp"


def at(days):
    return T0 + dt.timedelta(days=days)


def tables(spark, docs, stages, chunked):
    return {
        "manifest": spark.createDataFrame([("u", d, "src") for d in docs], "user_id string, doc_id string, source string"),
        "stages": spark.createDataFrame([("u", *s) for s in stages], STAGES),
        "chunked": spark.createDataFrame([("u", *c) for c in chunked], "user_id string, doc_id string, chunker string"),
        "current_versions": spark.createDataFrame([("chunk", "c-2"), ("extract", "e-1")], "stage string, version string"),
    }


def due(spark, **t):
    return sorted(r["doc_id"] for r in incremental.documents_to_chunk(tables(spark, **t)).collect())


def test_cases_of_the_rule(spark):
    good = "c-2:e-1"
    stages = [
        ("ok", "extract", "e-1", "o", at(1)), ("ok", "chunk", good, "o", at(1)),
        ("older", "extract", "e-1", "o", at(2)), ("older", "chunk", good, "o", at(1)),
        ("version", "extract", "e-1", "o", at(1)), ("version", "chunk", "c-1:e-1", "o", at(2)),
        ("unwritten", "extract", "e-1", "o", at(1)), ("unwritten", "chunk", good, "o", at(2)),
        ("failed", "extract", "e-1", "o", at(1)), ("failed", "chunk", good, None, at(2)),
        ("untimed", "extract", "e-1", "o", None),
        ("again", "extract", "e-0", "o", at(1)), ("again", "extract", "e-1", "o", at(3)), ("again", "chunk", good, "o", at(4)), ("again", "extract", "e-9", None, at(9)),
        ("gone", "extract", "e-1", "o", at(1)),
    ]
    docs = ["ok", "older", "version", "unwritten", "failed", "untimed", "again", "never"]
    chunked = [("ok", good), ("ok", good), ("ok", "c-1:e-0"), ("older", good), ("version", "c-1:e-1"), ("failed", good), ("again", good), ("unwritten", None)]
    assert due(spark, docs=docs + ["ok"], stages=stages + stages[:2], chunked=chunked) == ["failed", "older", "unwritten", "version"]


def test_empty_tables(spark):
    assert due(spark, docs=[], stages=[], chunked=[]) == []


@pytest.fixture
def kept(spark, tmp_path):
    return incremental.ChangedPartitions(spark, str(tmp_path / "state"), ["user_id", "doc_id"], 8)


def total(inputs):
    return inputs["x"].groupBy("user_id", "doc_id").agg(F.sum("v").alias("v"))


def rows(spark, data):
    return {"x": spark.createDataFrame(data, "user_id string, doc_id string, v int")}


def test_only_changed_partitions_are_replaced(spark, kept):
    data = [(f"u{i % 5}", str(i), i) for i in range(40)]
    assert len(kept.refresh(total, rows(spark, data))) > 5
    assert kept.refresh(total, rows(spark, list(reversed(data)))) == []
    changed = [(u, d, 100 if d == "7" else v) for u, d, v in data]
    assert len(kept.refresh(total, rows(spark, changed))) == 1
    got = {r["doc_id"]: r["v"] for r in kept.read().collect()}
    assert got == {d: v for _, d, v in changed}
    # a removed key leaves its partition, a repeated row counts
    assert len(kept.refresh(total, rows(spark, changed[1:] + changed[1:2]))) >= 1
    got = {r["doc_id"]: r["v"] for r in kept.read().collect()}
    assert "0" not in got and got["1"] == 2
    kept.refresh(total, rows(spark, []))
    assert kept.read().count() == 0


def test_a_failed_run_is_repeated(spark, kept, monkeypatch):
    data = [("u", str(i), i) for i in range(10)]
    kept.refresh(total, rows(spark, data))
    new = [("u", str(i), i * 2) for i in range(10)]
    real = kept._replace

    def fails(df, name):
        if name == "fingerprints":
            raise RuntimeError("lost")
        real(df, name)

    monkeypatch.setattr(kept, "_replace", fails)
    with pytest.raises(RuntimeError):
        kept.refresh(total, rows(spark, new))
    monkeypatch.setattr(kept, "_replace", real)
    assert kept.refresh(total, rows(spark, new))
    assert sorted(r["v"] for r in kept.read().collect()) == [i * 2 for i in range(10)]


def test_shared_inputs_change_every_partition(spark, kept):
    data, shared = rows(spark, [("u", "1", 1), ("v", "2", 1)]), lambda v: {"s": spark.createDataFrame([(v,)], "v int")}
    n = len(kept.refresh(total, data, shared(1)))
    assert n >= 2 and kept.refresh(total, data, shared(1)) == []
    assert len(kept.refresh(total, data, shared(2))) == n


def test_a_value_that_moves_beside_a_null_is_a_change(spark, kept):
    kind = "user_id string, doc_id string, v int, a string, b string, s struct<x:string,y:string>, l array<string>"
    base = ("u", "d", 1, "v1", None, ("p", None), ["q", None])
    frame = lambda *row: {"x": spark.createDataFrame([row], kind)}
    marks = set()
    for row in (base, ("u", "d", 1, None, "v1", ("p", None), ["q", None]), ("u", "d", 1, "v1", None, (None, "p"), ["q", None]), ("u", "d", 1, "v1", None, None, ["q", None]), ("u", "d", 1, "v1", None, ("p", None), [None, "q"]), ("u", "d", 1, "v1", None, ("p", None), None), ("u", "d", 1, "v1", "", ("p", None), ["q", None])):
        marks.add(frame(*row)["x"].select(incremental.row_hash(frame(*row)["x"])).first()[0])
        assert kept.refresh(total, frame(*row))
    assert len(marks) == 7


def test_changes_of_one_user_recompute_little_and_a_large_user_is_split(spark, tmp_path):
    kept = incremental.ChangedPartitions(spark, str(tmp_path / "state"), ["user_id", "doc_id"], 32)
    data = [(f"u{i % 60}" if i % 3 else "hot", f"d{i}", i) for i in range(1700)]
    whole = kept.refresh(total, rows(spark, data))
    assert len(whole) > 32
    changed = [(u, d, -v if u in ("u1", "u2", "u4", "u5") else v) for u, d, v in data]
    assert sum(a != b for a, b in zip(data, changed)) > 100
    assert len(kept.refresh(total, rows(spark, changed))) <= 4
    # a few documents of the large user touch only their pieces
    few = [(u, d, 7 if u == "hot" and v < 12 else v) for u, d, v in changed]
    assert len(kept.refresh(total, rows(spark, few))) <= 4
    # a user that becomes large moves its keys; nothing is lost or doubled
    grown = few + [("u1", f"n{i}", i) for i in range(900)]
    kept.refresh(total, rows(spark, grown))
    assert sorted((r["user_id"], r["doc_id"], r["v"]) for r in kept.read().collect()) == sorted(grown)


def test_null_keys_and_clashing_columns(spark, kept):
    data = {"x": spark.createDataFrame([(None, None, 1, 5, "m"), ("u", None, 2, 6, "n")], "user_id string, doc_id string, v int, part int, mark string")}
    kept.refresh(total, data)
    assert sorted(r["v"] for r in kept.read().collect()) == [1, 2]


def test_the_rules_read_the_modules_they_take_names_from(monkeypatch):
    before = incremental.rules_of(incremental.documents_to_chunk)
    real = incremental.inspect.getsource
    monkeypatch.setattr(incremental.inspect, "getsource", lambda m: real(m) + ("#" if m.__name__ == "quire.functions.tables" else ""))
    assert incremental.rules_of(incremental.documents_to_chunk) != before
