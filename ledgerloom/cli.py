"""Command line: ``python -m ledgerloom.cli --data FOLDER COMMAND ...``; prints JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import ledgerloom
from ledgerloom.api import Engine, graph, report
from ledgerloom.functions import columns as fn
from ledgerloom.functions import sections
from ledgerloom.operators import catalog, chunking, evaluation, pipeline
from ledgerloom.server import Service, serve
from ledgerloom.session import local_session, table
from ledgerloom.sources import files
from ledgerloom.sources.client import Client


def _show(df: DataFrame) -> None:
    for row in df.toJSON().toLocalIterator():
        print(row)


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="ledgerloom")
    top.add_argument("--data", default="data")
    top.add_argument("--index", type=int, default=1, help="index version")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("version", "check", "companies", "index-versions", "parse-report", "export-graph"):
        sub.add_parser(name)
    for name in ("query", "ask"):
        p = sub.add_parser(name)
        p.add_argument("question")
        p.add_argument("--k", type=int, default=10)
        p.add_argument("--mode", choices=["vector", "text", "hybrid"], default="hybrid")
        if name == "query":
            p.add_argument("--company")
            p.add_argument("--form")
    p = sub.add_parser("get-chunk")
    p.add_argument("chunk_id", type=int)
    p = sub.add_parser("chunk")
    p.add_argument("--strategy", action="append")
    p.add_argument("--max-tokens", type=int)
    p.add_argument("--out", required=True)
    p = sub.add_parser("embed")
    p.add_argument("--strategy", required=True)
    p.add_argument("--params-hash", required=True)
    p = sub.add_parser("ingest")
    p.add_argument("submissions", help="JSON files of submission indexes")
    p.add_argument("--base", required=True, help="address that filings are fetched from")
    p.add_argument("--raw", required=True)
    p.add_argument("--form", action="append")
    p.add_argument("--limit", type=int, default=2)
    p = sub.add_parser("serve")
    p.add_argument("--port", type=int, default=8000)
    p.add_argument("--log", required=True, help="folder that runs are logged in")
    for name in ("eval", "check-golden"):
        p = sub.add_parser(name)
        p.add_argument("golden")
        if name == "eval":
            p.add_argument("--mode", choices=["vector", "text", "hybrid", "agent"], default="hybrid")
            p.add_argument("--threshold", type=float, default=0.68)
    args = top.parse_args(argv)
    if args.command == "version":
        print(ledgerloom.__version__)
        return 0
    if args.command == "export-graph":
        print(graph())
        return 0
    spark = local_session()
    read = lambda name: table(spark, args.data, name)
    engine = lambda: Engine.over(spark, args.data, lambda q: fn.nibbles(q, 64), args.index)
    if args.command == "check":
        print(json.dumps({"spark": spark.version, "documents": read("documents").count(), "chunks": read("chunks").count()}))
    elif args.command == "companies":
        _show(catalog.company_filings(read("documents")))
    elif args.command == "index-versions":
        _show(read("index_versions"))
    elif args.command == "parse-report":
        docs = read("documents")
        _show(sections.hit_rate(docs, sections.detect_sections(docs)))
    elif args.command in ("query", "ask"):
        asked = spark.createDataFrame([(1, args.question)], "question_id long, query string")
        own = engine()
        _show(own.search(asked, args.k, args.mode, args.company, args.form).orderBy("rank") if args.command == "query" else own.ask(asked, args.k, args.mode))
    elif args.command == "get-chunk":
        found = engine().get_chunk(args.chunk_id)
        if found.isEmpty():
            print(json.dumps({"error": f"no chunk {args.chunk_id}"}))
            return 1
        _show(found)
    elif args.command == "chunk":
        docs = read("documents")
        made = chunking.chunk(docs, chunking.get_strategies(args.strategy, args.max_tokens), sections.detect_sections(docs, "accession_no"))
        made.write.mode("overwrite").partitionBy("strategy", "params_hash").parquet(args.out)
    elif args.command == "ingest":
        settings = files.Settings.read()
        web = Client(settings.user_agent, settings.max_rps)
        found = files.submissions(spark, args.submissions)
        print(json.dumps(pipeline.ingest(catalog.Store(spark, args.data), web, found, args.base, args.raw, args.form or ["10-K", "10-Q"], args.limit)))
    elif args.command == "serve":
        serve(Service(spark, engine(), read("query_runs"), store=catalog.Store(spark, args.log)), port=args.port).serve_forever()
    elif args.command == "embed":
        index, provider = catalog.Index(catalog.Store(spark, args.data)), catalog.HashProvider(32)
        print(json.dumps(index.embed_pending(provider, index.get_or_create(provider, args.strategy, args.params_hash))))
    else:
        golden = files.golden(spark, args.golden)
        specs = files.golden_specs(golden)
        own = engine()
        if args.command == "check-golden":
            dead = evaluation.dead_specs(specs, own.corpus)
            _show(dead)
            return int(not dead.isEmpty())
        asked = golden.select(F.col("id").alias("question_id"), F.col("question").alias("query"), "type", "refuse", "require")
        print(report(args.mode, own.evaluate(asked, specs, args.mode, args.threshold), list(files.TYPES)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
