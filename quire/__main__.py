"""Command line: python -m quire config|register|extract|chunk|index|ingest|inspect|search."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.operators.embedding import EmbeddingError
from quire.plans.engine import Engine, StoreError
from quire.plans.settings import ConfigError, load_settings

SHOWN = 20


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="quire")
    commands = main.add_subparsers(dest="command", required=True)
    commands.add_parser("config", help="resolved settings and documents by source and label")
    commands.add_parser("register", help="compare the files of the sources with the manifest").add_argument("--source", default="all")
    for name in ("extract", "chunk", "index", "ingest"):
        commands.add_parser(name).add_argument("--force", action="store_true")
    inspect = commands.add_parser("inspect", help="pages or chunks of one document")
    inspect.add_argument("query")
    inspect.add_argument("--page", type=int)
    inspect.add_argument("--chunks", action="store_true")
    search = commands.add_parser("search", help="the nearest chunks to a question")
    search.add_argument("question")
    search.add_argument("--subject")
    search.add_argument("--doc-type")
    search.add_argument("--limit", type=int, default=5)
    return main


def report(title: str, rows: DataFrame) -> None:
    """How many of each status, and the first of those that need a look."""
    print(title, ", ".join(f"{r['status']}: {r['n']}" for r in rows.groupBy("status").agg(F.count("*").alias("n")).orderBy("status").collect()) or "nothing to do")
    for r in rows.where("status in ('error', 'missing', 'moved', 'duplicate')").orderBy("status", "rel_path").limit(SHOWN).collect():
        print(f"  {r['status']}: {r['rel_path']}" + (f" ({r['detail']})" if r["detail"] else ""))


def run(engine: Engine, args: argparse.Namespace) -> None:
    if args.command == "config":
        print(json.dumps(engine.settings.described(), indent=2, ensure_ascii=False))
        for r in engine.describe_sources().orderBy("source", "subject", "doc_type").collect():
            print("  ".join(str(x if x is not None else "*") for x in r))
    elif args.command == "register":
        report("register", engine.register(args.source))
    elif args.command == "ingest":
        for stage, rows in engine.ingest(args.force).items():
            report(stage, rows)
    elif args.command in ("extract", "chunk", "index"):
        report(args.command, getattr(engine, args.command)(args.force))
        if args.command == "chunk":
            for r in engine.audit().limit(SHOWN).collect():
                print(f"  removed in {r['n_documents']} documents: {r['text']}")
    elif args.command == "inspect":
        for r in engine.inspect(args.query, args.page, args.chunks).collect():
            if args.page is not None:
                print(r["text"])
            elif args.chunks:
                print(r["chunk_index"], r["page"], r["part"], r["word_count"], r["language"], r["header"])
            else:
                print(r["number"], r["orientation"], r["char_count"], r["language"], (r["title"] or "")[:60])
    else:
        for r in engine.search(args.question, args.subject, args.doc_type, args.limit).collect():
            print(f"{r['score']:.4f}  {r['rel_path']} p. {r['page']}  {r['snippet']}")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        settings = load_settings()
        spark = spark or SparkSession.builder.appName("quire").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        run(Engine(spark, settings), args)
    except (ConfigError, StoreError, EmbeddingError, LookupError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
