"""The stages of a build: ingest, chunk, embed. Each skips what is done, so a stage can be run again at any time."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import columns as fn
from ledgerloom.functions.html import html_text
from ledgerloom.functions.sections import detect_sections
from ledgerloom.operators import catalog
from ledgerloom.operators.chunking import Strategy, chunk
from ledgerloom.session import durable
from ledgerloom.sources.client import Client
from ledgerloom.sources.files import plain_path, present, raw_files, write_file

DOCUMENTS = "accession_no string, cik string, company string, form_type string, filing_date date, period date, source_url string, raw_path string, content_hash string, size_bytes long, ingested_at timestamp"
PARAMS = "strategy string, params_hash string, params string"
BY = ["strategy", "params_hash"]
#: Fetched filings that are registered at once.
REGISTERED = 1000


def raw_path(folder: str):
    return F.concat(F.lit(f"{folder.rstrip('/')}/"), fn.cik_number(F.col("cik")).cast("string"), F.lit("/"), F.col("accession_no"), F.lit("."), F.element_at(F.split("primary_document", "\\."), -1))


def ingest(store: catalog.Store, client: Client, submissions: DataFrame, base: str, raw_folder: str, forms: list[str], most: int) -> dict[str, int]:
    """Registers the newest ``most`` filings of each company and form; gives counts by action and by form.

    Known filings whose raw file is there are skipped; those whose file is gone are fetched again and keep their
    row. Files are fetched on the driver, one by one at the client's pace, and registered ``REGISTERED`` at a time;
    a run that dies leaves at most so many files that the next run fetches again.
    """
    spark = store.spark
    documents = store.read("documents", DOCUMENTS)
    filings = catalog.select_filings(submissions, forms, most).withColumn("raw_path", plain_path(raw_path(raw_folder)))
    filings = filings.withColumn("source_url", fn.source_url(base, F.col("cik"), F.col("accession_no"), F.col("primary_document")))
    acted = durable(catalog.classify_ingest(filings, documents, present(spark, raw_folder)))
    rows: list[tuple] = []

    def register() -> None:
        if rows:
            new = spark.createDataFrame(rows, DOCUMENTS)
            have = store.read("documents", DOCUMENTS)
            store.replace("documents", catalog.upsert(have, new, "accession_no", ["raw_path", "content_hash", "size_bytes", "ingested_at"]))
            rows.clear()

    for r in acted.where("action <> 'skipped'").toLocalIterator():
        digest, size = client.download(r.source_url, r.raw_path, lambda to, body: write_file(spark, to, body))
        rows.append((r.accession_no, r.cik, r.company, r.form_type, r.filing_date, r.period, r.source_url, r.raw_path, digest, size, datetime.datetime.now(datetime.UTC)))
        if len(rows) == REGISTERED:
            register()
    register()
    counts = acted.groupBy("action", "form_type").count().collect()
    out: dict[str, int] = {}
    for r in counts:
        for key in (r.action, r.form_type):
            out[key] = out.get(key, 0) + r["count"]
    return out


def parsed(documents: DataFrame, raw: DataFrame) -> DataFrame:
    """Documents with the clean text of their raw file; those without a file have none and don't come out."""
    found = raw.select(plain_path(F.col("raw_path")).alias("raw_path"), F.col("text").alias("raw_text"))
    return documents.join(found, "raw_path").withColumn("text", html_text(F.col("raw_text"))).drop("raw_text")


def parse_filings(store: catalog.Store, raw_folder: str) -> DataFrame:
    return parsed(store.read("documents", DOCUMENTS), raw_files(store.spark, raw_folder))


def chunk_documents(store: catalog.Store, documents: DataFrame, strategies: list[Strategy], force: bool = False) -> dict[str, int]:
    """Chunks what has no chunk of a strategy yet, or with ``force`` everything; gives the chunks written by strategy.

    ``documents`` has ``accession_no``, ``form_type`` and ``text``. A chunk's number is a hash of its key, so it is
    the same in each run. Forced documents lose the chunks that they had of the strategy and parameters; those of
    other documents stay. Their partition is replaced in one step.
    """
    import json

    params = store.spark.createDataFrame([(s.name, s.params_hash, json.dumps(s.params)) for s in strategies], PARAMS)
    new = catalog.insert_ignore(store.read("chunk_param_sets", PARAMS), params, BY)
    store.append("chunk_param_sets", new)
    out = {}
    for s in strategies:
        have = store.read("chunks", "document_id string, strategy string, params_hash string")
        todo = documents if force else catalog.unchunked(documents, have, s.name, s.params_hash)
        made = chunk(todo, [s], detect_sections(todo, "accession_no"))
        made = made.withColumn("chunk_id", F.xxhash64("document_id", *BY, "ordinal")).withColumn("created_at", F.current_timestamp())
        made = durable(made)
        out[s.name] = made.count()
        if force and store.exists("chunks"):
            own = store.read("chunks").where((F.col("strategy") == s.name) & (F.col("params_hash") == s.params_hash))
            kept = own.join(todo.select(F.col("accession_no").alias("document_id")), "document_id", "left_anti")
            store.replace_partition("chunks", {"strategy": s.name, "params_hash": s.params_hash}, kept.unionByName(made.select(*kept.columns)).drop(*BY))
        elif out[s.name]:
            store.append("chunks", made, BY)
    return out
