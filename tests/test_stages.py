from __future__ import annotations

import json

from pyspark.sql import functions as F

from ledgerloom.operators import catalog, chunking, pipeline
from ledgerloom.sources import client, files

FILING = "<html><body><p>Item 1. Business</p><p>{}</p><p>Item 1A. Risk Factors</p><p>{}</p></body></html>"


def test_ingest_chunk_embed_and_again(spark, tmp_path):
    store = catalog.Store(spark, str(tmp_path / "store"))
    recent = {"accessionNumber": ["0-25-1", "0-24-2", "0-24-3"], "form": ["10-K", "10-Q", "8-K"], "filingDate": ["2025-01-31", "2024-10-01", "2024-09-01"], "reportDate": ["", "", ""], "primaryDocument": ["a.htm", "b.htm", "c.htm"]}
    (tmp_path / "s.json").write_text(json.dumps({"cik": 7, "name": "Mini", "filings": {"recent": recent}}))
    body = FILING.format("word " * 200, "risk " * 300).encode()
    fetched = []
    web = client.Client("me me@x.example", 10_000, lambda u, h: fetched.append(u) or (200, {}, body))
    run = lambda: pipeline.ingest(store, web, files.submissions(spark, str(tmp_path / "s.json")), "https://x.example/data", str(tmp_path / "raw"), ["10-K", "10-Q"], 2)
    assert run() == {"downloaded": 2, "10-K": 1, "10-Q": 1}
    assert run() == {"skipped": 2, "10-K": 1, "10-Q": 1} and len(fetched) == 2 and fetched[0].startswith("https://x.example/data/7/0")
    (tmp_path / "raw" / "7" / "0-25-1.htm").unlink()
    assert run()["refreshed"] == 1 and store.read("documents").count() == 2

    docs = pipeline.parse_filings(store, str(tmp_path / "raw"))
    strategies = chunking.get_strategies(most=120)
    first = pipeline.chunk_documents(store, docs, strategies)
    assert all(n > 0 for n in first.values()) and set(first) == {"fixed", "recursive", "section_aware"}
    assert set(pipeline.chunk_documents(store, docs, strategies).values()) == {0}
    before = {r.chunk_id: r.content_hash for r in store.read("chunks").collect()}
    assert pipeline.chunk_documents(store, docs, strategies[:1], force=True) == {"fixed": first["fixed"]}
    assert {r.chunk_id: r.content_hash for r in store.read("chunks").collect()} == before
    # forcing one document leaves the chunks of the other
    part = docs.where("accession_no = '0-25-1'")
    pipeline.chunk_documents(store, part.withColumn("text", F.lit("short " * 30)), strategies[:1], force=True)
    sizes = {r.document_id: r.n for r in store.read("chunks").where("strategy = 'fixed'").groupBy("document_id").agg(F.count("*").alias("n")).collect()}
    assert sizes["0-25-1"] == 1 and sizes["0-24-2"] == first["fixed"] // 2
    pipeline.chunk_documents(store, part, strategies[:1], force=True)
    assert {r.chunk_id: r.content_hash for r in store.read("chunks").collect()} == before
    labels = {r.section for r in store.read("chunks").where("strategy = 'section_aware'").collect()}
    assert labels == {"Item 1. Business", "Item 1A. Risk Factors"}

    index, provider = catalog.Index(store), catalog.HashProvider()
    version = index.get_or_create(provider, "recursive", strategies[1].params_hash)
    made = index.embed_pending(provider, version)
    assert made["embedded"] > 0 and index.embed_pending(provider, version)["embedded"] == 0
    # other parameters are another version, and the old vectors stay
    more = chunking.get_strategies(["recursive"], 60)
    pipeline.chunk_documents(store, docs, more)
    other = index.get_or_create(provider, "recursive", more[0].params_hash)
    index.embed_pending(provider, other)
    assert other != version and index.vectors(version).count() == made["embedded"]
