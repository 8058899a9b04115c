"""The engine's surface: search, ask, look up, evaluate and report over a folder of tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.columns import excerpt
from ledgerloom.operators import catalog, evaluation, routing
from ledgerloom.operators import search as s
from ledgerloom.session import durable, table

MOST_HITS = 20


class Engine:
    """Batches of questions against one index version.

    ``vectors`` turns a column of query texts into vectors of the index's model. ``corpus`` is as
    ``search.corpus`` gives it, ``aliases`` as ``routing.company_aliases``.
    """

    def __init__(self, corpus: DataFrame, documents: DataFrame, vectors: Callable[[Column], Column], chunks: DataFrame | None = None, answerer: routing.Answerer = routing.extractive):
        self.corpus, self.documents, self.vectors, self.chunks, self.answerer = corpus, documents, vectors, chunks, answerer

    @classmethod
    def over(cls, spark: SparkSession, folder: str, fn_vectors: Callable[[Column], Column], version: int | None = None) -> Engine:
        versions = table(spark, folder, "index_versions")
        row = (versions.where(F.col("index_version_id") == version) if version is not None else catalog.latest_ready(versions)).first()
        if row is None:
            raise LookupError("no index version is ready")
        chunks, documents = table(spark, folder, "chunks"), table(spark, folder, "documents")
        vectors = table(spark, folder, f"embeddings_v{row.index_version_id}")
        return cls(s.corpus(chunks, vectors, documents, row.strategy, row.params_hash), documents, fn_vectors, chunks)

    @cached_property
    def aliases(self) -> DataFrame:
        return routing.company_aliases(self.documents)

    @cached_property
    def _filings(self) -> DataFrame:
        company = F.regexp_replace("cik", "[^0-9]", "").cast("bigint").cast("string")
        return self.documents.select(company.alias("company"), F.upper(F.trim("form_type")).alias("form_type"), "filing_date", "accession_no")

    def _with_vectors(self, questions: DataFrame) -> DataFrame:
        return questions.withColumn("vector", self.vectors(F.col("query")))

    def company_number(self, company: str) -> str:
        """The number of a company that is named by one of its spellings or by its number; else what was given."""
        asked = self.documents.sparkSession.createDataFrame([(company,)], "name string")
        found = routing.resolved(asked, self.aliases).first().company
        return str(int(found)) if found.isdigit() else found

    def search(self, questions: DataFrame, k: int = 10, mode: str = "hybrid", company: str | None = None, form_type: str | None = None, after: bool = False) -> DataFrame:
        """The best chunks of each question, with their filing; ``k`` is held within 1 and 20.

        A company, by name or number, is a filter of the search. A form is one too, or with ``after`` one of its result, which
        may then have fewer rows than ``k``.
        """
        k = max(1, min(MOST_HITS, k))
        company = None if company is None else self.company_number(company)
        legs = s.single_legs(self._with_vectors(questions)).withColumn("company", F.lit(company).cast("string"))
        corpus = self.corpus if form_type is None or after else self.corpus.where(F.col("form_type") == form_type.upper())
        hits = s.search(corpus, legs, k, mode).join(self.corpus.select("chunk_id", "company", "form_type", "document_id", "section", "text"), "chunk_id")
        if form_type is not None and after:
            hits = hits.where(F.col("form_type") == form_type.upper())
        return hits.select("question_id", "rank", "chunk_id", "company", "form_type", "document_id", "section", F.round("score", 4).alias("score"), excerpt(F.col("text"), 300).alias("excerpt"))

    def _retrieved(self, planned: DataFrame, k: int, mode: str) -> DataFrame:
        """Hits of planned questions, each by its route; out-of-scope ones have none."""
        lookup = planned.where("route = 'lookup'")
        nothing = F.lit(None).cast("string")
        named = F.when(F.size("companies") > 0, F.element_at("companies", 1))
        legs = lookup.select("question_id", "query", "vector", F.lit(0).alias("nth"), named.alias("company"), nothing.alias("document_id"))
        comparison = s.company_legs(planned.where("route = 'comparison'"))
        temporal = planned.where("route = 'temporal'").select("question_id", "query", "vector", F.element_at("companies", 1).alias("company"), "form_type")
        every = legs.unionByName(comparison).unionByName(s.filing_legs(temporal, self._filings))
        return s.fan_out(self.corpus, every, k, mode)

    def plan_retrieve(self, questions: DataFrame, k: int = 10, mode: str = "hybrid") -> tuple[DataFrame, DataFrame]:
        """Plans and hits. A lookup has one leg, so its merged list is its list."""
        planned = routing.planned(self._with_vectors(questions), self.aliases)
        planned = durable(planned)  # legs are read from it several times
        return planned, self._retrieved(planned, k, mode)

    def ask_logged(self, store: catalog.Store, questions: DataFrame, k: int = 10, mode: str = "hybrid", version: int = 1) -> DataFrame:
        """``ask``, with a run appended to the log for each question, answered or refused."""
        began = time.perf_counter()
        answers = durable(self.ask(questions, k, mode))
        catalog.log_runs(store, questions, answers, version, mode, 1000 * (time.perf_counter() - began))
        return answers

    def ask(self, questions: DataFrame, k: int = 10, mode: str = "hybrid") -> DataFrame:
        """``(question_id, route, rewritten, refused, reason, answer, citations, retrieved_chunk_ids, scores, top_vector_score)``.

        Questions whose evidence isn't enough are rewritten and tried once more; what fails again, or is out
        of scope, is refused with the reason. One row for each question.
        """
        first = self._graded(questions.select("question_id", "query"), k, mode)
        again = first.where("not graded_ok and route <> 'out_of_scope'").select("question_id", routing.rewritten(F.col("query"), F.col("companies")).alias("query"))
        second = self._graded(again, k, mode).withColumn("rewritten", F.lit(True))
        kept = first.join(second.select("question_id"), "question_id", "left_anti").withColumn("rewritten", F.lit(False))
        final = durable(kept.unionByName(second))
        shown = final.where("graded_ok").select("question_id", F.posexplode(F.arrays_zip("retrieved_chunk_ids", "scores")).alias("pos", "h"))
        shown = shown.select("question_id", (F.col("pos") + 1).alias("rank"), F.col("h.retrieved_chunk_ids").alias("chunk_id"), F.col("h.scores").alias("score"))
        answers = self.answerer(routing.evidence(shown, self.corpus))
        refusal = F.concat(F.lit("Not covered by this corpus ("), F.col("reason"), F.lit(")."))
        out = final.join(answers, "question_id", "left")
        return out.select(
            "question_id", "route", "rewritten", (~F.col("graded_ok")).alias("refused"), F.when(~F.col("graded_ok"), F.col("reason")).alias("reason"),
            F.when(F.col("graded_ok"), F.col("answer")).otherwise(refusal).alias("answer"), F.coalesce("citations", F.array().cast("array<string>")).alias("citations"),
            "retrieved_chunk_ids", "scores", "top_vector_score",
        )

    def _graded(self, questions: DataFrame, k: int, mode: str) -> DataFrame:
        planned, hits = self.plan_retrieve(questions, k, mode)
        lists = routing.hit_lists(hits, self.corpus)
        joined = planned.drop("vector").join(lists, "question_id", "left")
        empty = {"retrieved_chunk_ids": "array<bigint>", "scores": "array<double>", "hit_companies": "array<string>"}
        for name, kind in empty.items():
            joined = joined.withColumn(name, F.coalesce(name, F.array().cast(kind)))
        return durable(routing.graded(joined.fillna(0.0, ["top_vector_score"])))

    def get_chunk(self, chunk_id: int) -> DataFrame:
        """The chunk with its filing; no row if there is none."""
        return catalog.chunk_details((self.chunks if self.chunks is not None else self.corpus).where(F.col("chunk_id") == chunk_id), self.documents)

    def list_companies(self) -> DataFrame:
        return catalog.company_filings(self.documents)

    def evaluate(self, questions: DataFrame, specs: DataFrame, mode: str = "hybrid", threshold: float = routing.BAR, k: int = 10) -> DataFrame:
        """Judgments of golden questions ``(question_id, query, type, refuse, require)``; mode agent plans them first."""
        if mode == "agent":
            planned, hits = self.plan_retrieve(questions, k)
        else:
            hits = s.search(self.corpus, s.single_legs(self._with_vectors(questions)), k, mode)
        out = evaluation.judged(questions, specs, durable(hits), self.corpus, threshold)
        if mode == "agent":
            low = planned.select("question_id", ((F.col("route") == "out_of_scope")).alias("off"), routing.bar(F.col("companies")).alias("bar"))
            out = out.join(low, "question_id").withColumn("refused", F.col("off") | (F.col("top_vector_score") < F.col("bar"))).drop("off", "bar")
        found = evaluation.relevant_universe(specs, self.corpus)
        return out.join(found, "question_id", "left").fillna(0, ["relevant_universe"])


def compare(engines: dict[str, Engine], modes: list[str], questions: DataFrame, specs: DataFrame, threshold: float = routing.BAR) -> DataFrame:
    """A row of metrics for each engine and mode over the same questions."""
    out = None
    for name, engine in engines.items():
        for mode in modes:
            one = evaluation.summary(engine.evaluate(questions, specs, mode, threshold)).select(F.lit(name).alias("name"), F.lit(mode).alias("mode"), "*")
            out = one if out is None else out.unionByName(one)
    return out


STAGES = [("ingest", "parse"), ("parse", "chunk"), ("chunk", "embed"), ("embed", "plan"), ("plan", "retrieve"), ("retrieve", "grade"), ("grade", "answer"), ("grade", "rewrite once"), ("rewrite once", "retrieve"), ("grade", "refuse"), ("answer", "log"), ("refuse", "log")]


def graph() -> str:
    """The stages of a build and of a question as a Mermaid graph."""
    names = {n: f"s{i}" for i, n in enumerate(dict.fromkeys(x for pair in STAGES for x in pair))}
    return "\n".join(["graph TD", *(f"  {names[a]}[{a}] --> {names[b]}[{b}]" for a, b in STAGES), ""])


def report(name: str, judgments: DataFrame, types: list[str]) -> str:
    """An evaluation as Markdown: metrics, latency where it was measured, recall by type, the sweep and the misses."""
    judgments = durable(judgments)
    total = evaluation.summary(judgments).first().asDict()
    lines = [f"# Evaluation: {name}", "", "| metric | value |", "|---|---|", *(f"| {k} | {v:.4g} |" for k, v in total.items())]
    if "latency_ms" in judgments.columns and (spent := evaluation.latencies(judgments.withColumn("all", F.lit(1)), ["all"]).first()):
        lines += [f"| p50_ms | {spent.p50:.4g} |", f"| p95_ms | {spent.p95:.4g} |"]
    lines += ["", "Cost: none, no model is called."]
    kinds = evaluation.by_type(judgments, types).first().asDict()
    lines += ["", "## recall@5 by type", "", "| type | recall@5 |", "|---|---|", *(f"| {k} | {'-' if v is None else f'{v:.2f}'} |" for k, v in kinds.items())]
    lines += ["", "## Refusal by threshold", "", "| threshold | precision | recall |", "|---|---|---|"]
    lines += [f"| {r.threshold:.2f} | {r.refusal_precision:.2f} | {r.refusal_recall:.2f} |" for r in evaluation.sweep(judgments).orderBy("threshold").collect()]
    missed = [r.question_id for r in evaluation.misses(judgments).orderBy("question_id").collect()]
    return "\n".join([*lines, "", "## Misses", "", ", ".join(map(str, missed)) or "none", ""])
