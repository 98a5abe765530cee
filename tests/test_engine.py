import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quire.operators.embedding import EmbeddingError, HashEmbedder, HttpEmbedder, embedder_for
from quire.plans.engine import Engine, StoreError
from quire.plans.settings import Chunking, ConfigError, settings_folder, load_settings, make
from quire.sources import files as FS
from quire.sources.buckets import BucketTable
from quire.sources.loaders import HtmlLoader, PdfLoader, Registry, TextLoader, default_registry, load_pages
from quire.sources.snapshots import SnapshotTable
from quire.streaming import folder

CONFIG = {"user": {"id": "me", "university": "U", "degree": "D"}, "subjects": {"nets": {"name": "Networks", "taken_in": "2025-26"}, "maths": {"name": "Maths", "taken_in": "2024-25", "professor": "P"}}}


@pytest.fixture
def project(tmp_path):
    labelled, inbox = tmp_path / "labelled", tmp_path / "inbox"
    for path, text in {
        labelled / "nets/theory/slides_2023-24.txt": "# Routers\nRouters forward packets between networks and keep a table.\fSwitches learn addresses on their ports all day.",
        labelled / "maths/exams/exam.txt": "Integrals measure areas below the curves of functions.",
        labelled / "nets/odd/x.txt": "A folder that is no type of document.",
        inbox / "note.md": "Matrices map vectors to vectors in linear algebra courses.",
        inbox / "copy.txt": "Integrals measure areas below the curves of functions.",
        inbox / ".hidden/n.txt": "hidden words that nobody sees here",
        inbox / "~$lock.txt": "lock file of an editor program here",
    }.items():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return make(CONFIG | {"sources": {"labelled": {"root": "labelled", "labelled": True}, "inbox": {"root": "inbox"}, "absent": {"root": "none"}}, "data_dir": "data"}, str(tmp_path))


def statuses(df):
    return sorted((r["rel_path"], r["status"]) for r in df.collect())


def test_ingest_search_and_rerun(spark, project, tmp_path):
    engine = Engine(spark, project)
    reports = engine.ingest()
    assert statuses(reports["register"]) == [("copy.txt", "duplicate"), ("maths/exams/exam.txt", "new"), ("nets/odd/x.txt", "error"), ("nets/theory/slides_2023-24.txt", "new"), ("note.md", "new")]
    assert engine.chunks.read().count() == 4 and engine.count("me") == 4 and engine.count("you") == 0
    hits = engine.search("switches learn addresses", k=2).collect()
    assert hits[0]["page"] == 2 and hits[0]["header"] == "Networks · slides 2023 24 · p. 2"
    assert [h["rel_path"] for h in engine.search("switches learn addresses", subject="maths").collect()] == ["maths/exams/exam.txt"]
    assert engine.search("switches", user_id="you").count() == 0
    assert engine.search("switches", doc_type="nothing").count() == 0
    with pytest.raises(ConfigError):
        engine.search("x", subject="physics")
    before = sorted(map(str, engine.points.read().collect()))
    again = engine.ingest()
    assert {r["status"] for r in again["register"].collect()} == {"unchanged", "duplicate", "error"}
    assert all(again[s].count() == 0 for s in ("extract", "chunk", "index"))
    assert sorted(map(str, engine.points.read().collect())) == before
    # inspecting
    assert engine.inspect("slides").count() == 2 and engine.inspect("slides", page=2, chunks=True).count() == 1
    with pytest.raises(LookupError):
        engine.inspect("nothing like it")
    with pytest.raises(LookupError):
        engine.inspect("m")
    # a move keeps the id and all stages, and the label is the current one
    old, new = tmp_path / "labelled/maths/exams/exam.txt", tmp_path / "labelled/nets/exams/exam.txt"
    new.parent.mkdir()
    old.rename(new)
    assert ("nets/exams/exam.txt", "moved") in statuses(engine.register("labelled"))
    assert engine.search("integrals measure areas", subject="nets", k=1).first()["metadata"]["subject"] == "nets"
    # a lost output is made again, and forced runs give the same points
    engine.points.replace(spark.createDataFrame(engine.points.read().where("page = 1").collect(), engine.points.schema))
    assert engine.index().count() == 1 and engine.count("me") == 4
    assert engine.index(force=True).count() == 3 and engine.count("me") == 4
    # other settings cut again
    from dataclasses import replace

    other = Engine(spark, replace(project, chunking=Chunking(6, 5, 2)))
    assert other.chunk().count() == 3 and other.chunks.read().count() > 4
    with pytest.raises(StoreError):
        Engine(spark, project, embedder=HashEmbedder(32)).index()
    assert engine.describe_sources().count() > 0 and engine.audit().count() == 0


def test_settings_are_strict(tmp_path):
    base = CONFIG | {"sources": {"s": {"root": "r"}}, "data_dir": "d"}
    for wrong in ({"colour": 1}, {"chunking": {"max_word": 1}}, {"chunking": {"max_words": 10, "target_words": 20}}, {"subjects": {"Bad Slug": {"name": "n", "taken_in": "x"}}}, {"user": {"id": "x"}}, {"cleaning": {"min_share": 0}}, {"cleaning": {"min_pages": 1}}, {"sources": {"s": 3}}, {"user": {"id": "No Slug", "university": "U", "degree": "D"}}, {"subjects": {"nets": {"name": "n", "taken_in": "2024-27"}}}, {"subjects": {"nets": {"name": "n", "taken_in": "24-25"}}}):
        with pytest.raises(ConfigError):
            make(base | wrong)
    assert make(base | {"chunking": {"min_words": 0}}).chunking.min_words == 0
    settings = make(base | {"embedder_url": "http://u:p@h"}, "/root")
    assert settings.data_dir == "/root/d" and settings.described()["embedder_url"] == "(set)"
    with pytest.raises(ConfigError):
        settings.source("t")
    with pytest.raises(Exception):
        settings.data_dir = "x"


def test_environment_goes_first(tmp_path):
    (tmp_path / "quire.yaml").write_text(json.dumps(CONFIG | {"sources": {"notes": {"root": "here"}}, "data_dir": "file"}))
    inner = tmp_path / "a/b"
    inner.mkdir(parents=True)
    assert settings_folder(inner) == tmp_path
    with pytest.raises(ConfigError):
        settings_folder(tmp_path, "other.yaml")
    assert load_settings(tmp_path, {}).data_dir.endswith("file")
    (tmp_path / ".env").write_text("QUIRE_DATA_DIR='dotted'\n")
    assert load_settings(tmp_path, {}).data_dir.endswith("dotted") and load_settings(tmp_path, {"QUIRE_DATA_DIR": ""}).data_dir.endswith("dotted")
    assert load_settings(tmp_path, {"QUIRE_DATA_DIR": "set"}).data_dir.endswith("set")
    assert load_settings(tmp_path, {}).source("notes").root.endswith("here") and load_settings(tmp_path, {"QUIRE_SOURCE_NOTES": "/there"}).source("notes").root == "/there"


def test_scan_finds_either_case_and_hides(spark, tmp_path):
    for name in ("a.TXT", "b/c.txt", "b/.d/e.txt", "~$f.txt", "g.pdf", "sp ace.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    rows = FS.scan(spark, str(tmp_path), [".txt"])
    assert sorted(r["rel_path"] for r in rows.collect()) == ["a.TXT", "b/c.txt", "sp ace.txt"]
    assert FS.scan(spark, str(tmp_path / "none"), [".txt"]).count() == 0


def test_loaders(spark):
    with pytest.raises(ValueError):
        Registry(TextLoader(), TextLoader())
    registry = default_registry()
    assert registry.find("x/A.TXT").name == "text" and registry.find("x.y/z") is None and registry.version("q.html") == "html-1"
    page = HtmlLoader().load(b"<html><title>A &amp; b</title><script>x</script><p>One<br>two</p><img src=x></html>")[0]
    assert page["title"] == "A & b" and page["text"].split() == ["One", "two"] and page["image_count"] == 1
    files = spark.createDataFrame([("k", "a.txt", bytearray(b"one\ftwo")), ("l", "b.pdf", bytearray(b"no pdf")), ("m", "c.zip", bytearray(b""))], "k string, rel_path string, content binary")
    rows = load_pages(files, registry, ["k"]).collect()
    assert [(r["k"], r["number"]) for r in rows if r["error"] is None] == [("k", 1), ("k", 2)] and {r["k"] for r in rows if r["error"]} == {"l", "m"}


def test_titles_and_pictures_come_from_spans(spark, tmp_path):
    span = lambda k, text, size, top: {"ord": k, "text": text, "size": size, "top": top, "page_height": 800.0}

    class SpanLoader(TextLoader):
        name = "spans"

        def load(self, content):
            return [{"number": 1, "width": 600.04, "height": 800.0, "text": "Big title\nbody", "title": None, "image_count": 2, "spans": [span(0, "Big title", 20.0, 10.0), span(1, "body text that is longer", 10.0, 300.0)], "thumbnail": b"png"}]

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x")
    engine = Engine(spark, make(CONFIG | {"sources": {"in": {"root": "in"}}, "data_dir": "data", "buckets": 8}, str(tmp_path)), Registry(SpanLoader()))
    engine.register()
    assert statuses(engine.extract()) == [("a.txt", "extracted")]
    row = engine.pages.read().first()
    assert (row["title"], row["width"], row["image_count"]) == ("Big title", 600.0, 2) and row["thumbnail"].startswith("thumbnails/me/") and engine.thumbnails.read().first()["png"] == b"png"


def test_pdf_pages_through_a_stand_in_library(monkeypatch):
    """What the loader asks of the library: the rotation is applied to places, pages keep their number and pictures."""
    import types

    class Rect:
        def __init__(self, box):
            self.width, self.height, self.y0 = box[2] - box[0], box[3] - box[1], box[1]

        def __mul__(self, turned):
            return types.SimpleNamespace(y0=self.y0 + turned)

    class Page:
        number, rect, rotation_matrix = 0, Rect((0, 0, 612.04, 792)), 5

        def get_text(self, kind, sort):
            return "text" if kind == "text" else {"blocks": [{"lines": [{"spans": [{"text": "T", "size": 12, "bbox": (0, 7, 1, 9)}]}]}, {"image": 1}]}

        def get_images(self):
            return [1]

        def get_pixmap(self, matrix, alpha):
            return types.SimpleNamespace(tobytes=lambda kind: f"{kind} {matrix:.3f}".encode())

    class Document(list):
        needs_pass = False

        def __enter__(self):
            return self

        def __exit__(self, *a):
            pass

    document = Document([Page()])
    monkeypatch.setitem(__import__("sys").modules, "pymupdf", types.SimpleNamespace(open=lambda stream, filetype: document, Rect=Rect, Matrix=lambda x, y: x))
    page = PdfLoader(306).load(b"")[0]
    assert (page["number"], page["width"], page["text"], page["image_count"], page["thumbnail"]) == (1, 612.0, "text", 1, b"png 0.500")
    assert page["spans"] == [{"ord": 0, "text": "T", "size": 12.0, "top": 12.0, "page_height": 792.0}]
    Document.needs_pass = True
    with pytest.raises(ValueError):
        PdfLoader().load(b"")


def test_one_changed_document_touches_one_bucket(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), "user_id string, doc_id string, v string", buckets=64)
    rows = spark.range(2000).selectExpr("'u' user_id", "concat('d', id) doc_id", "repeat(cast(id as string), 20) v")
    assert len(table.replace_documents(rows, rows)) == 64 and table.read().count() == 2000
    size = lambda v: sum(f.stat().st_size for f in (tmp_path / f"t/v={v}").rglob("*.parquet"))
    new = spark.createDataFrame([("u", "d7", "new"), ("u", "d7", "two")], table.schema)
    assert len(table.replace_documents(new, new)) == 1 and size(2) * 30 < size(1)
    assert sorted(r["v"] for r in table.read().where("doc_id = 'd7'").collect()) == ["new", "two"] and table.read().count() == 2001
    # touched documents without new rows go; null keys and failed runs
    table.replace_documents(new.limit(0), new)
    table.replace_documents(spark.createDataFrame([(None, None, "n")], table.schema), new.limit(0))
    assert table.read().count() == 2000 and table.replace_documents(new.limit(0), new.limit(0)) == []
    before = table.state()
    with pytest.raises(Exception):
        table.replace_documents(new.selectExpr("user_id", "doc_id", "raise_error('lost') v"), new)
    assert table.state() == before and table.read().count() == 2000
    table.replace(new)
    assert table.read().count() == 2


def test_only_due_files_are_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / f"in/f{k}.txt").write_text(f"file number {k} with some words")
    engine = Engine(spark, make(CONFIG | {"sources": {"in": {"root": "in"}}, "data_dir": "data", "buckets": 8}, str(tmp_path)))
    engine.ingest()
    (tmp_path / "in/f9.txt").write_text("a file that came later with words")
    engine.register()
    (tmp_path / "in/f0.txt").chmod(0)  # a root user reads it all the same, so its content is changed too
    (tmp_path / "in/f0.txt").write_bytes(b"changed behind the back of the manifest")
    assert statuses(engine.extract()) == [("f9.txt", "extracted")]
    assert engine.pages.read().where("text like 'changed%'").count() == 0 and engine.pages.read().count() == 4


def test_snapshots_swap_whole(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), "a int")
    assert table.read().count() == 0
    for n in (1, 2, 3):
        table.replace(table.read().unionByName(spark.createDataFrame([(n,)], "a int")))
    assert table.version() == 3 and table.read().count() == 3


@pytest.fixture
def service():
    class Handler(BaseHTTPRequestHandler):
        calls, answer, code = [], None, 200

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            Handler.calls.append(len(body["input"]))
            data = json.dumps({"embeddings": Handler.answer if Handler.answer is not None else [[float(len(t)), 1.0] for t in body["input"]]}).encode()
            self.send_response(Handler.code)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", Handler
    server.shutdown()


def test_http_embedder(spark, service):
    url, handler = service
    client = HttpEmbedder(url, "m", 2, batch_size=2)
    assert client.embed(spark, ["a", "bb", "ccc"]) == [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0]] and handler.calls == [2, 1]
    df = spark.createDataFrame([("a",), (None,)], "t string").coalesce(1)
    assert [r["embedding"] for r in client.transform(df, "t").collect()] == [[1.0, 1.0], [0.0, 1.0]]
    for answer in ([[1.0]], [[1.0, 2.0], [1.0, 2.0]]):
        handler.answer = answer
        with pytest.raises(EmbeddingError):
            client.ask(["a"])
    handler.answer = None
    for code in (404, 500):
        handler.code = code
        with pytest.raises(EmbeddingError):
            client.ask(["a"])
    with pytest.raises(EmbeddingError):
        HttpEmbedder("http://127.0.0.1:9", "m", 2, timeout=2).ask(["a"])
    for bad in (("http", None), ("other", "u")):
        with pytest.raises(EmbeddingError):
            embedder_for(bad[0], "m", 2, url=bad[1])


def test_folder_stream_sees_each_content_once(spark, tmp_path):
    inbox, seen = tmp_path / "inbox", []
    inbox.mkdir()
    (inbox / "a.txt").write_text("one")
    (inbox / "b.txt").write_text("one")

    def batch(df, _):
        seen.extend(r["doc_id"] for r in df.collect())

    def go():
        folder.run(folder.watch(spark, str(inbox), [".txt"]), str(tmp_path / "ck"), batch).awaitTermination()

    go()
    assert len(seen) == 1
    (inbox / "c.txt").write_text("two")
    go()
    go()
    assert len(seen) == 2


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from quire.__main__ import main

    (tmp_path / "quire.yaml").write_text(json.dumps(CONFIG | {"sources": {"s": {"root": "s", "labelled": True}}, "data_dir": "data", "embedder_url": "http://user:secret@host"}))
    for path, text in {"s/nets/theory/one.txt": "Routers forward packets between many networks.", "s/loose.txt": "x"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    monkeypatch.chdir(tmp_path)

    def call(*args):
        code = main(args, spark)
        return code, capsys.readouterr()

    code, said = call("ingest")
    assert code == 0 and "register error: 1, new: 1" in said.out and "loose.txt" in said.out and "index indexed: 1" in said.out
    assert "one.txt p. 1" in call("search", "routers", "--subject", "nets")[1].out
    assert call("search", "routers", "--subject", "none")[0] == 1 and call("inspect", "nothing")[0] == 1
    assert call("inspect", "one", "--page", "1")[1].out.startswith("Routers") and "portrait" in call("inspect", "one")[1].out and "Networks" in call("inspect", "one", "--chunks")[1].out
    code, said = call("config")
    assert code == 0 and "secret" not in said.out and "nets" in said.out
    assert "nothing to do" in call("extract")[1].out and call("register", "--source", "zzz")[0] == 1
    monkeypatch.chdir("/")
    assert call("config")[0] == 1


def test_folder_stream_takes_files_with_old_times(spark, tmp_path):
    import os

    inbox, seen = tmp_path / "inbox", []
    inbox.mkdir()

    def go(name, text, time):
        (inbox / name).write_text(text)
        os.utime(inbox / name, (time, time))
        folder.run(folder.watch(spark, str(inbox), [".txt"]), str(tmp_path / "ck"), lambda df, _: seen.extend(r["path"][-5:] for r in df.collect())).awaitTermination()

    go("a.txt", "one", 1_700_000_000)
    go("b.txt", "two", 1_690_000_000)
    go("c.txt", "one", 1_690_000_000)
    assert seen == ["a.txt", "b.txt"]
