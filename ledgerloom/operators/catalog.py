"""Tables of the engine: ingest, chunks, index versions and vectors, kept as Parquet folders.

Replacements are staged beside the table or partition and moved into place by rename. A run that dies before
leaves it as it was; one that dies between the renames is ended by whoever looks at the table next. One writer
at a time is assumed, as the pipeline's stages run one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import columns as fn
from ledgerloom.operators.search import ranked
from ledgerloom.session import durable

SCHEMA_VERSION = 1
VERSIONS = "index_version_id int, embedding_model string, embedding_dim int, strategy string, params_hash string, chunk_params string, schema_version int, status string, chunk_count long, created_at timestamp"


class Store:
    """A folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def exists(self, name: str) -> bool:
        self._recover(name)
        return self._fs.exists(self._path(self.at(name)))

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        if not self.exists(name) and schema:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(self.at(name))

    def append(self, name: str, rows: DataFrame, by: list[str] | None = None) -> None:
        self._recover(name)
        writer = rows.write.mode("append")
        (writer.partitionBy(*by) if by else writer).parquet(self.at(name))

    def replace(self, name: str, rows: DataFrame, by: list[str] | None = None) -> None:
        """The whole table anew, also from a plan that reads it."""
        self._recover(name)
        self._swap(self.at(name), rows, by)

    def replace_partition(self, name: str, values: dict[str, str], rows: DataFrame) -> None:
        """One partition anew, also from a plan that reads it; ``rows`` is without the columns of ``values``."""
        self._recover(name)
        inner = "/".join(f"{c}={v}" for c, v in values.items())
        self._fs.mkdirs(self._path(f"{self.at(name)}/{inner}").getParent())
        self._swap(f"{self.at(name)}/{inner}", rows, None)

    @staticmethod
    def _beside(target: str) -> tuple[str, str]:
        """Where a folder is staged and kept meanwhile; readers of the table pass over such names."""
        parent, name = target.rsplit("/", 1)
        return f"{parent}/.new-{name}", f"{parent}/.old-{name}"

    def _swap(self, target: str, rows: DataFrame, by: list[str] | None) -> None:
        new, old = self._beside(target)
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(new)
        self._fs.delete(self._path(old), True)
        if self._fs.exists(self._path(target)):
            self._rename(target, old)
        self._rename(new, target)
        self._fs.delete(self._path(old), True)

    def _rename(self, a: str, b: str) -> None:
        if not self._fs.rename(self._path(a), self._path(b)):
            raise OSError(f"{a} couldn't be renamed to {b}")

    def _recover(self, name: str) -> None:
        """Ends a replacement that died between its renames: the new folder if it is whole, else the old one."""
        at = self.at(name)
        for pattern in (self._beside(at)[1], f"{at}/.old-*", f"{at}/*/.old-*"):
            for f in self._fs.globStatus(self._path(pattern)) or ():
                parent, old = f.getPath().getParent().toString(), f.getPath().getName()
                target = f"{parent}/{old.removeprefix('.old-')}"
                new, _ = self._beside(target)
                if self._fs.exists(self._path(target)):
                    continue  # it died when only the old folder was left to be deleted
                whole = self._fs.exists(self._path(f"{new}/_SUCCESS"))
                self._rename(new if whole else f.getPath().toString(), target)


def insert_ignore(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The new rows whose key doesn't exist; of several with one key, one."""
    return new.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, key: str, renewed: list[str]) -> DataFrame:
    """Existing rows, with ``renewed`` columns from the new row of their key, and the new rows of other keys."""
    fresh = new.dropDuplicates([key])
    changed = existing.alias("e").join(fresh.select(key, *renewed).alias("n"), key, "left")
    kept = changed.select(*[F.coalesce(f"n.{c}", f"e.{c}").alias(c) if c in renewed else (F.col(c) if c == key else F.col(f"e.{c}")) for c in existing.columns])
    return kept.unionByName(fresh.join(existing.select(key), key, "left_anti").select(*existing.columns))


def classify_ingest(filings: DataFrame, documents: DataFrame, present: DataFrame) -> DataFrame:
    """``filings`` with ``action``: skipped, refreshed (known, but its raw file is gone) or downloaded.

    ``present`` has the ``raw_path`` of the files that exist.
    """
    known = documents.select("accession_no", F.col("raw_path").alias("known_path")).groupBy("accession_no").agg(F.max("known_path").alias("known_path"))
    files = present.select(F.col("raw_path").alias("known_path"), F.lit(True).alias("there")).distinct()
    out = filings.join(known, "accession_no", "left").join(files, "known_path", "left")
    action = F.when(F.col("known_path").isNull(), "downloaded").when(F.col("there"), "skipped").otherwise("refreshed")
    return out.withColumn("action", action).drop("known_path", "there")


def select_filings(submissions: DataFrame, forms: list[str], most: int) -> DataFrame:
    """The newest ``most`` filings of each company and wanted form, from submissions with parallel arrays.

    Arrays of unequal length fail the query. Forms are compared in upper case; filings without a primary
    document are left out; equal dates keep the order of the source.
    """
    recent = "filings.recent."
    names = ["accessionNumber", "form", "filingDate", "reportDate", "primaryDocument"]
    sizes = [F.size(recent + n) for n in names]
    equal = F.array_min(F.array(*sizes)) == F.array_max(F.array(*sizes))
    zipped = F.arrays_zip(*[F.col(recent + n).alias(n) for n in names])
    rows = submissions.withColumn("_ok", F.assert_true(equal, F.lit("submission arrays differ in length")))
    rows = rows.where(F.col("_ok").isNull())
    each = rows.select(F.col("cik").cast("string").alias("cik"), F.col("name").alias("company"), F.posexplode(zipped).alias("pos", "f"))
    each = each.select(
        "cik", "company", "pos", F.col("f.accessionNumber").alias("accession_no"), fn.form_name(F.col("f.form")).alias("form_type"),
        fn.iso_date(F.col("f.filingDate")).alias("filing_date"), fn.iso_date(F.col("f.reportDate")).alias("period"), F.col("f.primaryDocument").alias("primary_document"),
    )
    wanted = each.where(F.col("form_type").isin([f.upper() for f in forms]) & (F.coalesce("primary_document", F.lit("")) != ""))
    return ranked(wanted, ["cik", "form_type"], "filing_date", "pos", most=most, name="nth").drop("pos")


def unchunked(documents: DataFrame, chunks: DataFrame, strategy: str, params: str) -> DataFrame:
    """Documents that have no chunk of the strategy and parameters."""
    done = chunks.where((F.col("strategy") == strategy) & (F.col("params_hash") == params)).select(F.col("document_id").alias("accession_no"))
    return documents.join(done, "accession_no", "left_anti")


def one_text_each(chunks: DataFrame) -> DataFrame:
    """``(content_hash, chunk_id, text)``: of chunks with equal hashes, the one with the smallest number."""
    least = F.min(F.struct("chunk_id", "text")).alias("c")
    return chunks.groupBy("content_hash").agg(least).select("content_hash", "c.chunk_id", "c.text")


def pending_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One text for each hash that has no vector yet. The anti-join comes first, so known texts aren't grouped."""
    return one_text_each(chunks.select("content_hash", "chunk_id", "text").join(vectors.select("content_hash"), "content_hash", "left_anti"))


class Provider(Protocol):
    """What turns texts into vectors; it is shipped to the workers and may load its model there, once."""

    name: str
    dim: int

    def passages(self, texts: list[str]) -> list[list[float]]: ...

    def queries(self, texts: list[str]) -> list[list[float]]: ...


class HashProvider:
    """Vectors without meaning, the same everywhere: leading bytes of the SHA-256 over 255, of unit length."""

    def __init__(self, dim: int = 8):
        self.dim, self.name = dim, f"hash-{dim}d"

    def passages(self, texts):
        import hashlib

        out = []
        for t in texts:
            raw = [b / 255 for b in hashlib.sha256(t.encode()).digest()[: self.dim]]
            norm = sum(x * x for x in raw) ** 0.5 or 1.0
            out.append([x / norm for x in raw])
        return out

    queries = passages


class PrefixedProvider:
    """A provider whose model wants an instruction before queries, and none before passages."""

    def __init__(self, inner: Provider, prefix: str = "Represent this sentence for searching relevant passages: "):
        self.inner, self.prefix, self.name, self.dim = inner, prefix, inner.name, inner.dim

    def passages(self, texts):
        return self.inner.passages(texts)

    def queries(self, texts):
        return self.inner.queries([self.prefix + t for t in texts])


def embedded(texts: DataFrame, provider: Provider, batch: int = 64) -> DataFrame:
    """``(content_hash, embedding, created_at)`` of ``(content_hash, text)``, by batches of the provider's size."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for low in range(0, len(rows), batch):
                part = rows.iloc[low : low + batch]
                vectors = provider.passages(part["text"].tolist())
                if len(vectors) != len(part):
                    raise ValueError("the provider gave another number of vectors than texts")
                yield pd.DataFrame({"content_hash": part["content_hash"], "embedding": vectors})

    out = texts.select("content_hash", "text").mapInPandas(run, "content_hash string, embedding array<float>")
    return out.withColumn("created_at", F.current_timestamp())


class Index:
    """Versions of the index: one for each model, strategy, parameters and schema."""

    def __init__(self, store: Store):
        self.store = store

    def versions(self) -> DataFrame:
        return self.store.read("index_versions", VERSIONS)

    def get_or_create(self, provider: Provider, strategy: str, params: str) -> int:
        own = self.versions().where(
            (F.col("embedding_model") == provider.name) & (F.col("strategy") == strategy) & (F.col("params_hash") == params) & (F.col("schema_version") == SCHEMA_VERSION)
        )
        if row := own.first():
            return row.index_version_id
        given = self.store.read("chunk_param_sets").where((F.col("strategy") == strategy) & (F.col("params_hash") == params)).first()
        if given is None:
            raise LookupError(f"no parameter set ({strategy}, {params}); chunk with it first")
        number = (self.versions().agg(F.max("index_version_id")).first()[0] or 0) + 1
        row = self.store.spark.createDataFrame(
            [(number, provider.name, provider.dim, strategy, params, given.params, SCHEMA_VERSION, "building", 0, None)], VERSIONS
        ).withColumn("created_at", F.current_timestamp())
        self.store.replace("index_versions", self.versions().unionByName(row))
        return number

    def get(self, number: int):
        row = version(self.versions(), number).first()
        if row is None:
            raise LookupError(f"no index version {number}")
        return row

    def vectors(self, number: int) -> DataFrame:
        return self.store.read(f"embeddings_v{number}", "content_hash string, embedding array<float>, created_at timestamp")

    def embed_pending(self, provider: Provider, number: int, rows_per_commit: int = 1_000_000) -> dict[str, int]:
        """Embeds what has no vector yet; a run after it embeds nothing. Vectors are appended, none is changed.

        Every ``rows_per_commit`` texts are committed, so a run that died is taken up where it was.
        """
        version = self.get(number)
        chunks = self.store.read("chunks").where((F.col("strategy") == version.strategy) & (F.col("params_hash") == version.params_hash))
        todo = durable(pending_embeddings(chunks, self.vectors(number)))
        name = f"embeddings_v{number}"
        before = self.vectors(number).count()
        parts = max(1, -(-todo.count() // rows_per_commit))
        for i in range(parts):
            # each part is a commit of its own: a run that dies has lost one, and the next takes what is left
            mine = todo.where(F.pmod(F.xxhash64("content_hash"), F.lit(parts)) == i) if parts > 1 else todo
            self.store.append(name, embedded(mine, provider))
        count = chunks.agg(F.count_distinct("content_hash")).first()[0]
        done = F.col("index_version_id") == number
        self.store.replace(
            "index_versions",
            self.versions().withColumn("status", F.when(done, "ready").otherwise(F.col("status"))).withColumn("chunk_count", F.when(done, F.lit(count)).otherwise(F.col("chunk_count"))),
        )
        return {"embedded": self.vectors(number).count() - before, "already_present": before}


RUNS = "run_id long, ts timestamp, query string, route string, index_version_id int, mode string, retrieved_chunk_ids array<bigint>, scores array<double>, top_vector_score double, rewritten boolean, refused boolean, refusal_reason string, answer string, llm_provider string, tokens_in int, tokens_out int, latency_ms double"


def log_runs(store: Store, asked: DataFrame, answers: DataFrame, version: int, mode: str, latency_ms: float) -> DataFrame:
    """Appends a run for each answered or refused question, numbered after those there, and gives the new rows.

    ``asked`` has ``question_id`` and ``query``; ``latency_ms`` is of the batch, shared by its runs.
    """
    last = store.read("query_runs", RUNS).agg(F.coalesce(F.max("run_id"), F.lit(0))).first()[0]
    rows = asked.select("question_id", "query").join(answers, "question_id")
    # a batch of questions is a stated set, so numbering it in order is bounded
    numbered = ranked(rows.withColumn("_one", F.lit(1)), ["_one"], "_one", "question_id", name="n")
    out = numbered.select(
        (F.col("n") + last).cast("long").alias("run_id"), F.current_timestamp().alias("ts"), "query", "route", F.lit(version).alias("index_version_id"), F.lit(mode).alias("mode"),
        "retrieved_chunk_ids", "scores", "top_vector_score", "rewritten", "refused", F.col("reason").alias("refusal_reason"), "answer", F.lit("none").alias("llm_provider"),
        F.lit(0).alias("tokens_in"), F.lit(0).alias("tokens_out"), F.lit(latency_ms).alias("latency_ms"),
    )
    store.append("query_runs", out)
    return store.read("query_runs").where(F.col("run_id") > last)


def check_schemas(store: Store, schemas: dict[str, str]) -> list[str]:
    """Holds declared schemas against a manifest beside the tables, and adds those it lacks; gives the added names.

    A schema that differs from the manifest's under the same name is an error: data may be written by it.
    """
    import hashlib

    own = [(name, hashlib.sha256(" ".join(text.split()).encode()).hexdigest()) for name, text in sorted(schemas.items())]
    known = {r.name: r.sha256 for r in store.read("schema_manifest", "name string, sha256 string").collect()}
    drifted = [name for name, digest in own if known.get(name, digest) != digest]
    if drifted:
        raise ValueError(f"schemas changed after they were applied: {drifted}")
    new = [x for x in own if x[0] not in known]
    if new:
        store.append("schema_manifest", store.spark.createDataFrame(new, "name string, sha256 string"))
    return [name for name, _ in new]


def company_names(documents: DataFrame) -> DataFrame:
    """``(cik, company, spellings)``: of a company's spellings the most frequent, of equals the first in order."""
    cik = F.regexp_replace("cik", "[^0-9]", "").cast("bigint")
    counts = documents.where("company is not null").groupBy(cik.alias("cik"), F.trim("company").alias("company")).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "company"))
    return counts.groupBy("cik").agg(best.alias("b"), F.count(F.lit(1)).alias("spellings")).select("cik", "b.company", "spellings")


def latest_ready(versions: DataFrame) -> DataFrame:
    """The newest version with status ready, or no row."""
    return versions.where("status = 'ready'").orderBy(F.desc("created_at"), F.desc("index_version_id")).limit(1)


def version(versions: DataFrame, number: int) -> DataFrame:
    """One version's row, or none."""
    return versions.where(F.col("index_version_id") == number)


def version_counts(versions: DataFrame, vectors: dict[int, DataFrame]) -> DataFrame:
    """The versions with the number of vectors of each, 0 where there is no table."""
    out = None
    for number, df in vectors.items():
        one = df.agg(F.count(F.lit(1)).alias("vectors")).withColumn("index_version_id", F.lit(number))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return versions.withColumn("vectors", F.lit(0).cast("long"))
    return versions.join(out, "index_version_id", "left").fillna(0, ["vectors"])


def chunk_details(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the registry's columns of their filing, the first delivery's."""
    first = documents.groupBy("accession_no").agg(F.min(F.struct("doc_id", "company", "form_type", "filing_date", "source_url")).alias("d"))
    own = first.select(F.col("accession_no").alias("document_id"), "d.company", "d.form_type", "d.filing_date", "d.source_url")
    return chunks.join(own, "document_id").select("chunk_id", "document_id", "company", "form_type", "filing_date", "source_url", "section", "text")


def company_filings(documents: DataFrame) -> DataFrame:
    """Per company its filings, newest first, each once. A company has a bounded number of filings, each a few words."""
    cik = F.regexp_replace("cik", "[^0-9]", "").cast("bigint")
    each = documents.select(cik.alias("cik"), "accession_no", fn.form_name(F.col("form_type")).alias("form_type"), "filing_date")
    each = each.groupBy("cik", "accession_no").agg(F.max("form_type").alias("form_type"), F.max("filing_date").alias("filing_date"))
    return ranked(each, ["cik"], "filing_date", "accession_no", name="nth")
