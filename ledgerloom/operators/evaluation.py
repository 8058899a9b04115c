"""Retrieval quality: judgments against specifications, recall, MRR, nDCG, refusal, sweeps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import quantiles

DEPTH = 10


def matches(spec: str = "s", row: str = "c") -> Column:
    """Whether a chunk with its document's columns satisfies all that a specification declares.

    Company, form and accession are equal, the section starts with the prefix, the text contains the words
    in any letter case. What is null isn't declared; a specification without any field matches nothing.
    Both sides have been through ``lowered``.
    """
    s, c = (lambda x: F.col(f"{spec}.{x}")), (lambda x: F.col(f"{row}.{x}"))
    fields = [
        (s("company"), c("company") == s("company")),
        (s("form_type"), c("form_type") == s("form_type")),
        (s("accession"), c("document_id") == s("accession")),
        (s("section_prefix"), F.startswith(F.coalesce(c("section"), F.lit("")), s("section_prefix"))),
        (s("must_contain"), F.contains(c("low"), s("needle"))),
    ]
    every = reduce(Column.__and__, [want.isNull() | holds for want, holds in fields])
    some = reduce(Column.__or__, [want.isNotNull() for want, _ in fields])
    return some & every


def lowered(df: DataFrame, text: str, name: str) -> DataFrame:
    """With ``text`` in lower case beside it, so that a join doesn't lower it again for each pair."""
    return df.withColumn(name, F.lower(text))


#: Specifications without a field to join by that one block may hold; with more the chunks are read once for each block.
BLOCK = 100_000


def pairs(specs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(spec_id, chunk_id)``: the chunks that each specification matches.

    A specification that names a filing or else a company is joined by it; the others are looked for by an
    automaton of their words and a table of their prefixes, all of a block in one pass over the chunks.
    """
    c = lowered(chunks.select("chunk_id", "company", "document_id", "form_type", "section", "text"), "text", "low").drop("text").alias("c")
    own = lowered(specs.select("spec_id", "company", "form_type", "accession", "section_prefix", "must_contain"), "must_contain", "needle")
    by_filing = own.where("accession is not null").alias("s")
    by_company = own.where("accession is null and company is not null").alias("s")
    joined = [c.join(by_filing, (F.col("c.document_id") == F.col("s.accession")) & matches()), c.join(by_company, (F.col("c.company") == F.col("s.company")) & matches())]
    rest = own.where("accession is null and company is null and (form_type is not null or section_prefix is not null or must_contain is not null)")
    found = [j.select("s.spec_id", "c.chunk_id") for j in joined]
    return reduce(DataFrame.unionByName, [*found, *_scanned(rest, c)])


def _scanned(specs: DataFrame, chunks: DataFrame) -> Iterator[DataFrame]:
    kind = dict(specs.dtypes)["spec_id"]
    rows: list = []
    block: list[list] = []
    for r in specs.select("spec_id", "form_type", "section_prefix", "needle").toLocalIterator():
        rows.append(tuple(r))
        if len(rows) == BLOCK:
            block.append(rows)
            rows = []
    for own in [*block, rows] if rows else block:
        sent = chunks.sparkSession.sparkContext.broadcast(own)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            search = _Block(sent.value)
            for batch in batches:
                spec, at = [], []
                for i, (form, section, low) in enumerate(zip(*(batch.column(j).to_pylist() for j in (1, 2, 3)), strict=True)):
                    for n in search.hits(form, section or "", low):
                        spec.append(search.rows[n][0])
                        at.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(spec, pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()), batch.column(0).take(pa.array(at, pa.int32()))], names=["spec_id", "chunk_id"])

        yield chunks.select("c.chunk_id", "c.form_type", "c.section", "c.low").mapInArrow(scan, f"spec_id {kind}, chunk_id {dict(chunks.dtypes)['chunk_id']}")


class _Block:
    """Specifications by their words, and those without by form and prefix."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        self.auto = ahocorasick.Automaton()
        needles: dict[str, list[int]] = {}
        self.plain: dict[tuple, list[int]] = {}
        for n, (_, form, prefix, needle) in enumerate(rows):
            if needle:
                needles.setdefault(needle, []).append(n)
            else:
                self.plain.setdefault((form, prefix or ""), []).append(n)
        for needle, own in needles.items():
            self.auto.add_word(needle, own)
        if needles:
            self.auto.make_automaton()
        self.words = bool(needles)
        self.sizes = sorted({len(prefix) for _, prefix in self.plain})
        # an empty text holds empty words only, a null one none
        self.bare = {n for own in self.plain.values() for n in own if rows[n][3] == ""}

    def hits(self, form: str | None, section: str, low: str | None) -> set[int]:
        found: set[int] = set()
        if self.words and low:
            for _, own in self.auto.iter(low):
                found.update(n for n in own if self.rows[n][1] in (None, form) and section.startswith(self.rows[n][2] or ""))
        for size in self.sizes:
            for f in {None, form}:
                found.update(self.plain.get((f, section[:size]), ()) if len(section) >= size else ())
        return found - self.bare if low is None else found


def universe(specs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(question_id, spec_id, chunks)``: how many chunks each specification matches, 0 too."""
    counts = pairs(specs, chunks).groupBy("spec_id").agg(F.count(F.lit(1)).alias("chunks"))
    return specs.select("question_id", "spec_id").join(counts, "spec_id", "left").fillna(0, ["chunks"])


def relevant_universe(specs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(question_id, relevant_universe)``: chunks that match any of a question's specifications."""
    asked = specs.select("question_id", "spec_id").distinct()
    found = pairs(specs, chunks).join(asked, "spec_id").select("question_id", "chunk_id").distinct()
    counts = found.groupBy("question_id").agg(F.count(F.lit(1)).alias("relevant_universe"))
    return specs.select("question_id").distinct().join(counts, "question_id", "left").fillna(0, ["relevant_universe"])


def dead_specs(specs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Specifications that no chunk matches."""
    return universe(specs, chunks).where("chunks = 0").select("question_id", "spec_id")


def judged(questions: DataFrame, specs: DataFrame, hits: DataFrame, chunks: DataFrame, threshold: float) -> DataFrame:
    """A row for each question: hits of its specifications at 1, 5 and 10, first relevant rank, gains, refusal.

    ``questions``: ``(question_id, type, refuse, require)``; ``hits``: ``(question_id, chunk_id, rank,
    top_vector_score)``. With ``require`` any, one satisfied specification is all.
    """
    own = hits.join(chunks.select("chunk_id", "company", "form_type", "document_id", "section", "text"), "chunk_id")
    pairs = lowered(own, "text", "low").alias("c").join(lowered(specs, "must_contain", "needle").alias("s"), (F.col("c.question_id") == F.col("s.question_id")) & matches())
    pairs = pairs.select("c.question_id", "s.spec_id", "c.rank")
    found = pairs.groupBy("question_id").agg(
        *[F.count_distinct(F.when(F.col("rank") <= k, F.col("spec_id"))).alias(f"hit{k}") for k in (1, 5, 10)],
        F.min("rank").alias("first_rank"),
        F.collect_set("rank").alias("ranks"),
    )
    top = hits.groupBy("question_id").agg(F.max("top_vector_score").alias("top_vector_score"))
    total = specs.groupBy("question_id").agg(F.count(F.lit(1)).alias("specs"))
    out = questions.join(total, "question_id", "left").join(found, "question_id", "left").join(top, "question_id", "left")
    any_one = (F.col("require") == "any") & (F.coalesce("specs", F.lit(0)) > 0)
    cap = lambda c: F.when(any_one, F.least(F.coalesce(c, F.lit(0)), F.lit(1))).otherwise(F.coalesce(c, F.lit(0)))
    gains = F.aggregate(F.coalesce("ranks", F.array().cast("array<int>")), F.lit(0.0), lambda s, r: s + F.when(r <= DEPTH, 1 / F.log2(r + 1.0)).otherwise(0.0))
    score = F.coalesce("top_vector_score", F.lit(0.0))
    return out.select(
        "question_id", "type", F.col("refuse").alias("should_refuse"), (score < threshold).alias("refused"), cap("specs").alias("specs"),
        *[cap(F.col(f"hit{k}")).alias(f"hit{k}") for k in (1, 5, 10)], "first_rank", gains.alias("dcg"), score.alias("top_vector_score"),
    )


def ideal(n: Column, depth: int = DEPTH) -> Column:
    """DCG of as many relevant hits in front as there are, up to ``depth``."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0.0), lambda s, i: s + F.when(i <= n, 1 / F.log2(i + 1.0)).otherwise(0.0))


def summary(judgments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """recall@1, 5, 10, MRR@10, nDCG@10, refusal precision and recall; 0, or 1 for refusal, over nothing.

    nDCG needs ``relevant_universe`` beside what ``judged`` gives.
    """
    asked = ~F.col("should_refuse")
    mean = lambda x: F.coalesce(F.avg(F.when(asked, x)), F.lit(0.0))
    recall = lambda k: F.when(F.col("specs") > 0, F.col(f"hit{k}") / F.col("specs")).otherwise(0.0)
    best = ideal(F.col("relevant_universe"))
    columns = [
        F.count(F.lit(1)).alias("questions"),
        *[mean(recall(k)).alias(f"recall_at_{k}") for k in (1, 5, 10)],
        mean(F.when(F.col("first_rank") <= DEPTH, 1 / F.col("first_rank")).otherwise(0.0)).alias("mrr_at_10"),
        mean(F.when(best > 0, F.col("dcg") / best).otherwise(0.0)).alias("ndcg_at_10"),
        *refusal(),
    ]
    return judgments.groupBy(*(by or [])).agg(*columns)


def refusal(refused: Column | None = None) -> list[Column]:
    refused = F.col("refused") if refused is None else refused
    both = F.count_if(refused & F.col("should_refuse"))
    ratio = lambda n: F.when(n > 0, both / n).otherwise(1.0)
    return [ratio(F.count_if(refused)).alias("refusal_precision"), ratio(F.count_if(F.col("should_refuse"))).alias("refusal_recall")]


def sweep(judgments: DataFrame, low: int = 40, high: int = 70, step: int = 2) -> DataFrame:
    """Refusal precision and recall at thresholds in hundredths, from the stored scores."""
    at = F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step)))
    rows = judgments.select("should_refuse", "top_vector_score", at.alias("hundredths"))
    rows = rows.withColumn("threshold", F.col("hundredths") / 100)
    return rows.groupBy("threshold").agg(*refusal(F.col("top_vector_score") < F.col("threshold")))


def by_type(judgments: DataFrame, types: list[str]) -> DataFrame:
    """One row: mean recall@5 of each type of question."""
    recall = F.when(F.col("specs") > 0, F.col("hit5") / F.col("specs")).otherwise(0.0)
    return judgments.where("not should_refuse").groupBy().pivot("type", types).agg(F.avg(recall))


def misses(judgments: DataFrame) -> DataFrame:
    """Questions that should be answered and got no relevant hit."""
    return judgments.where("not should_refuse and first_rank is null").select("question_id")


def latencies(judgments: DataFrame, by: list[str]) -> DataFrame:
    """Median and 95th percentile of ``latency_ms``, by nearest rank."""
    return quantiles.nearest_rank(judgments, by, "latency_ms", {"p50": 50, "p95": 95})


def golden_counts(questions: DataFrame) -> DataFrame:
    """One row: how many golden questions there are, were verified, are to be answered and to be refused."""
    return questions.agg(
        F.count(F.lit(1)).alias("questions"), F.count_if("verified").alias("verified"), F.count_if(~F.col("refuse")).alias("in_corpus"), F.count_if("refuse").alias("out_of_corpus")
    )
