"""Loaders: from a file's bytes to its pages. One for each format, chosen by extension."""

from __future__ import annotations

import html
import posixpath
import re
from collections.abc import Iterable, Iterator
from typing import Protocol

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

Page = dict[str, object]


class Loader(Protocol):
    """Name and version go into the extractor's version: a new version makes its documents again."""

    name: str
    version: int
    extensions: tuple[str, ...]

    def load(self, content: bytes) -> list[Page]: ...


class TextLoader:
    """Plain text and Markdown; a form feed begins a page. The first Markdown heading of a page is its title."""

    name, version, extensions = "text", 1, (".txt", ".md")

    def load(self, content: bytes) -> list[Page]:
        pages = []
        for number, text in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
            heading = re.search(r"(?m)^#{1,6}\s+(.+?)\s*#*$", text)
            pages.append({"number": number, "width": 595.0, "height": 842.0, "text": text, "title": heading[1] if heading else None, "image_count": 0})
        return pages


class HtmlLoader:
    """HTML as one page: the title element, the text without markup, scripts and styles, and the number of images."""

    name, version, extensions = "html", 1, (".html", ".htm")

    def load(self, content: bytes) -> list[Page]:
        source = content.decode("utf-8", "replace")
        title = re.search(r"(?is)<title[^>]*>(.*?)</title>", source)
        body = re.sub(r"(?is)<(script|style|title)\b.*?</\1\s*>|<!--.*?-->", " ", source)
        images = len(re.findall(r"(?i)<img\b", body))
        body = re.sub(r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n", body)
        text = html.unescape(re.sub(r"<[^>]*>", " ", body))
        text = "\n".join(" ".join(line.split()) for line in text.split("\n"))
        name = " ".join(html.unescape(title[1]).split()) if title else ""
        return [{"number": 1, "width": 595.0, "height": 842.0, "text": text, "title": name or None, "image_count": images}]


class PdfLoader:
    """PDF, where a PDF library is installed; a document under a password is an error.

    Besides its text a page gives its spans in reading order, with their size and the place where they are seen
    (rotation applied), from which the engine guesses the title, and a small picture.
    """

    name, version, extensions = "pdf", 2, (".pdf",)

    def __init__(self, thumbnail_width: int = 320):
        self.thumbnail_width = thumbnail_width

    def load(self, content: bytes) -> list[Page]:
        try:
            import pymupdf
        except ImportError as e:
            raise RuntimeError("no PDF library is installed") from e
        pages = []
        with pymupdf.open(stream=content, filetype="pdf") as document:
            if document.needs_pass:
                raise ValueError("the file is protected by a password")
            for page in document:
                box = page.rect
                lines = [line for block in page.get_text("dict", sort=True)["blocks"] for line in block.get("lines", ())]
                seen = [(s["text"], float(s["size"]), float((pymupdf.Rect(s["bbox"]) * page.rotation_matrix).y0)) for line in lines for s in line["spans"]]
                scale = self.thumbnail_width / box.width if box.width else 1.0
                picture = page.get_pixmap(matrix=pymupdf.Matrix(scale, scale), alpha=False).tobytes("png")
                pages.append(
                    {
                        "number": page.number + 1, "width": round(box.width, 1), "height": round(box.height, 1), "text": page.get_text("text", sort=True), "title": None, "image_count": len(page.get_images()),
                        "spans": [{"ord": k, "text": t, "size": size, "top": top, "page_height": float(box.height)} for k, (t, size, top) in enumerate(seen)], "thumbnail": picture,
                    }
                )
        return pages


class Registry:
    """Loaders by extension, in either case; two loaders cannot claim the same one."""

    def __init__(self, *loaders: Loader):
        self.loaders: dict[str, Loader] = {}
        for loader in loaders:
            self.register(loader)

    def register(self, loader: Loader) -> None:
        for extension in map(str.lower, loader.extensions):
            if extension in self.loaders:
                raise ValueError(f"{extension} has a loader already: {self.loaders[extension].name}")
            self.loaders[extension] = loader

    def find(self, path: str) -> Loader | None:
        dot = path.rfind(".")
        return self.loaders.get(path[dot:].lower()) if dot > path.rfind("/") else None

    @property
    def extensions(self) -> set[str]:
        return set(self.loaders)

    def version(self, path: str) -> str | None:
        loader = self.find(path)
        return f"{loader.name}-{loader.version}" if loader else None


def default_registry(thumbnail_width: int = 320) -> Registry:
    return Registry(TextLoader(), HtmlLoader(), PdfLoader(thumbnail_width))


SPAN = "struct<ord:int,text:string,size:double,top:double,page_height:double>"
PAGE = [
    ("number", "int", pa.int32()), ("width", "double", pa.float64()), ("height", "double", pa.float64()), ("text", "string", pa.string()), ("title", "string", pa.string()), ("image_count", "int", pa.int32()),
    ("spans", f"array<{SPAN}>", pa.list_(pa.struct([("ord", pa.int32()), ("text", pa.string()), ("size", pa.float64()), ("top", pa.float64()), ("page_height", pa.float64())]))), ("thumbnail", "binary", pa.binary()),
]


def read_bytes(path: str) -> bytes:
    """A file's bytes where a worker reads them; ``path`` is a URI or a local path."""
    scheme, rest = path.split(":", 1) if ":" in path else ("file", path)
    uri = "file://" + posixpath.join("/", rest.lstrip("/")) if scheme == "file" else path
    fs, inner = (pyarrow.fs.LocalFileSystem(), uri[7:]) if scheme == "file" else pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(inner) as stream:
        return stream.read()


def load_pages(files: DataFrame, registry: Registry, keys: list[str]) -> DataFrame:
    """(keys, extractor, the columns of ``PAGE``, error): the pages of files with ``rel_path`` and ``content``, or ``path`` to read it from.

    Only the bytes of the files that are given are read, each in the worker that loads it. A file that
    fails gives one row with its error and no page, so that it never stops the others.
    """
    origin = "content" if "content" in files.columns else "path"
    kinds = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, extractor string, " + ", ".join(f"{n} {k}" for n, k, _ in PAGE) + ", error string"

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            target = pa.schema([*[batch.schema.field(key) for key in keys], ("extractor", pa.string()), *[(n, a) for n, _, a in PAGE], ("error", pa.string())])
            for k in range(batch.num_rows):
                path = batch.column("rel_path")[k].as_py()
                own = {key: batch.column(key)[k].as_py() for key in keys} | {"extractor": registry.version(path)}
                try:
                    loader = registry.find(path)
                    if loader is None:
                        raise ValueError("no loader for this extension")
                    value = batch.column(origin)[k].as_py()
                    rows = [own | {n: page.get(n) for n, *_ in PAGE} | {"error": None} for page in loader.load(value if origin == "content" else read_bytes(value))]
                except Exception as e:  # noqa: BLE001
                    rows = [own | {n: None for n, *_ in PAGE} | {"error": f"{type(e).__name__}: {e}"}]
                yield from pa.Table.from_pylist(rows, target).to_batches()

    return files.select(*dict.fromkeys([*keys, "rel_path", origin])).mapInArrow(work, schema)


def extractor_version(registry: Registry, rel_path):
    """The version of the loader of each path, as a column."""
    dotted = F.lower(F.regexp_extract(rel_path, r"(\.[^./]*)$", 1))
    out = F.lit(None).cast("string")
    for extension, loader in registry.loaders.items():
        out = F.when(dotted == extension, F.lit(f"{loader.name}-{loader.version}")).otherwise(out)
    return out
