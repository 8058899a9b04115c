"""Subject areas of documents, from curated and learned terms found by a multi-pattern automaton.

Curated terms are of general use. Where there are labelled documents, terms of the corpus are learned from all
of them: words and pairs of words that stand almost only in documents of one subject.

A sentence goes to the subject whose terms weigh most in it; a term weighs its curated weight times its
rarity over the whole corpus. A paragraph's score for a subject is the share of that subject's sentences,
by length, among its sentences with any term, accounting and finance terms included. A document's score is
that of its best paragraph, and every subject above its threshold is assigned.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.subject_terms import curated
from ledgerloom.session import durable, spread

#: Ends of sentences; a blank line ends a paragraph.
_BREAK = re.compile(r"\n[^\S\n]*\n\s*|\n|(?<=[.!?])\s+")
#: The least share of a whole paragraph, so that one sentence among unrelated lines doesn't decide.
LEAST_OF_ALL = 0.25
THRESHOLD = 0.5
#: A learned term stands in so many labelled documents at least, or a 500th of them; the least share of a subject
#: among its documents, and how much greater that is than among all.
LEAST, SHARE, LIFT = 4, 0.7, 3.0
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Terms of one task that are counted in memory before they are passed on.
HELD = 300_000
GRID = (0.50, 0.48, 0.52, 0.46, 0.54, 0.44, 0.56, 0.42, 0.58, 0.40, 0.60, 0.35, 0.65)


class Matcher:
    """The automaton, built once in each worker."""

    def __init__(self, terms: list[tuple[str, str, float]]):
        self.auto = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for n, (term, _, _) in enumerate(terms):
            by.setdefault(term, []).append(n)
        for term, numbers in by.items():
            self.auto.add_word(term, (len(term), numbers))
        self.auto.make_automaton()

    def spans(self, text: str) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
        """Per sentence its paragraph and length; per match its term and sentence; lengths of paragraphs."""
        low = text.lower()
        starts, ends, paragraphs = [0], [], [0]
        for m in _BREAK.finditer(low):
            ends.append(m.start())
            starts.append(m.end())
            paragraphs.append(paragraphs[-1] + (m.group().count("\n") > 1))
        ends.append(len(low))
        terms, places = [], []
        size = len(low)
        for last, (length, numbers) in self.auto.iter_long(low):
            first, after = last - length + 1, last + 1
            if first and low[first - 1].isalnum():
                continue
            if after < size and low[after].isalnum():
                # a plural still counts
                more = 1 if low[after] in "sn" else 2 if low[after : after + 2] in ("es", "en") else 0
                if not more or (after + more < size and low[after + more].isalnum()):
                    continue
            place = bisect_right(starts, last) - 1
            for n in numbers:
                terms.append(n)
                places.append(place)
        lengths = [max(0, e - s) for s, e in zip(starts, ends, strict=True)]
        return paragraphs, lengths, terms, places, []


def matched(documents: DataFrame, key: str, text: str, terms: list) -> DataFrame:
    """``(key, whole, sentence, paragraph, length, term)``: for each document with a term, arrays by match.

    ``whole`` is the length of the paragraph of the match.
    """
    schema = f"`{key}` {dict(documents.dtypes)[key]}, whole array<int>, sentence array<int>, paragraph array<int>, length array<int>, term array<int>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in batches:
            at, lists = [], [[], [], [], [], []]
            for i, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                paragraphs, lengths, found, places, _ = matcher.spans(text)
                if not found:
                    continue
                total = [0] * (paragraphs[-1] + 1)
                for p, n in zip(paragraphs, lengths, strict=True):
                    total[p] += n
                at.append(i)
                own = [paragraphs[s] for s in places]
                for column, value in zip(lists, ([total[p] for p in own], places, own, [lengths[s] for s in places], found), strict=True):
                    column.append(value)
            kept = batch.column(0).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([kept, *(pa.array(x, pa.list_(pa.int32())) for x in lists)], names=[key, "whole", "sentence", "paragraph", "length", "term"])

    return spread(documents.select(key, text)).mapInArrow(find, schema)


def subject_scores(documents: DataFrame, key: str = "doc_id", text: str = "text", terms: list | None = None) -> DataFrame:
    """``(key, subject, score)`` of each document and each subject that one of its paragraphs has a sentence of.

    Null and empty texts have no score; repeated rows count each. A sentence with equal weights for
    several subjects counts for each by its part.
    """
    terms = curated() if terms is None else terms
    subjects = sorted({s for _, s, _ in terms})
    hits = durable(matched(documents, key, text, terms))
    each = hits.select(F.explode(F.array_distinct("term")).alias("term"))
    # no more rows than curated terms
    often = {r.term: r.n for r in each.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = max(1, hits.count())
    weight = np.array([w * np.log1p(total / often.get(i, 1)) for i, (_, _, w) in enumerate(terms)])
    subject_of = np.array([subjects.index(s) for _, s, _ in terms])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = [batch.column(i).flatten().to_numpy() for i in range(1, 6)]
            row = np.repeat(np.arange(batch.num_rows), batch.column(5).value_lengths().to_numpy())
            d, s, best, paid = scored(row, *flat, weight, subject_of, len(subjects))
            keep = paid >= LEAST_OF_ALL
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(d[keep])), pa.array([subjects[i] for i in s[keep]], pa.string()), pa.array(best[keep])],
                names=[key, "subject", "score"],
            )

    kind = dict(documents.dtypes)[key]
    out = hits.mapInArrow(score, f"`{key}` {kind}, subject string, score double")
    return out.where("subject <> 'finance'").groupBy(key, "subject").agg(F.max("score").alias("score"))


def scored(row, whole, sentence, paragraph, length, term, weight, subject_of, subjects):
    """Per paragraph and subject: its row, the subject, its share of matched and of all text."""
    # one number for each sentence of each row
    _, first, group = np.unique(row.astype(np.int64) << 32 | sentence, return_index=True, return_inverse=True)
    sums = np.zeros((len(first), subjects))
    np.add.at(sums, (group, subject_of[term]), weight[term])
    top = sums.max(axis=1, keepdims=True)
    wins = sums >= top - 1e-9
    share = wins * (length[first] / wins.sum(axis=1))[:, None]
    _, lead, block = np.unique(row[first].astype(np.int64) << 32 | paragraph[first], return_index=True, return_inverse=True)
    by = np.zeros((len(lead), subjects))
    np.add.at(by, block, share)
    known = by.sum(axis=1)
    p, s = np.nonzero(by)
    return row[first][lead][p], s, by[p, s] / np.maximum(known[p], 1), by[p, s] / np.maximum(whole[first][lead][p], 1)


def labelled(labels: DataFrame, key: str) -> DataFrame:
    """Distinct ``(key, subject)`` of all labelled documents."""
    return labels.where(f"{key} is not null and subject is not null").select(key, "subject").distinct()


def terms_of(text: str) -> set[str]:
    """Words of at least four letters, and pairs of words next to each other in a sentence."""
    out: set[str] = set()
    for sentence in _BREAK.split(text.lower()):
        own = _WORD.findall(sentence)
        out.update(w for w in own if len(w) > 3)
        out.update(f"{a} {b}" for a, b in zip(own, own[1:], strict=False))
    return out


def learned_terms(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", known: set[str] = frozenset()) -> list[tuple[str, str, float]]:
    """``(term, subject, weight)`` learned from all labelled documents.

    Documents are counted by term and subject within tasks first. As each term stands in a 500th of the documents, no
    more come back than 500 times the terms of an average one.
    """
    mine = labelled(labels, key)
    sets = mine.groupBy(key).agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    base = {r.subject: r.n for r in mine.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).collect()}
    subjects = sorted(s for s in base if s != "none")
    total = sets.count()
    if not subjects:
        return []
    place = {s: i for i, s in enumerate(subjects)}

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            rows = list(counts.values())
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(subjects) + 1)]
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *columns], names=["term", "n", *(f"s{i}" for i in range(len(subjects)))])

        for batch in batches:
            for whole, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = [place[s] + 1 for s in own if s in place]
                for term in terms_of(whole or ""):
                    row = counts.setdefault(term, [0] * (len(subjects) + 1))
                    row[0] += 1
                    for i in at:
                        row[i] += 1
                if len(counts) > HELD:
                    yield flush()
                    counts = {}
        yield flush()

    own = documents.select(key, text).join(sets, key).select(text, "subjects")
    columns = ["n", *(f"s{i}" for i in range(len(subjects)))]
    parts = own.mapInArrow(tally, ", ".join(["term string", *(f"{c} long" for c in columns)]))
    sums = parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in columns]).where(F.col("n") >= max(LEAST, -(-total // 500)))
    lift = F.array(*[F.struct((F.col(f"s{i}") / F.col("n") / (base[s] / total)).alias("lift"), (F.col(f"s{i}") / F.col("n")).alias("share"), F.lit(s).alias("subject")) for s, i in place.items()])
    best = sums.select("term", F.array_max(lift).alias("b")).where((F.col("b.lift") >= LIFT) & (F.col("b.share") >= SHARE))
    return sorted((r.term, r.subject, 1.0) for r in best.select("term", "b.subject").collect() if r.term not in known)


def calibrated(scores: DataFrame, labels: DataFrame, key: str = "doc_id") -> dict[str, float]:
    """The threshold of each subject with the best F1 on all labelled documents, near to one half in doubt."""
    labels = labelled(labels, key)
    known = labels.select(key).distinct()
    true = labels.where("subject <> 'none'").withColumn("true", F.lit(True))
    both = scores.join(known, key, "left_semi").join(true, [key, "subject"], "full_outer")
    said = [F.coalesce(F.col("score"), F.lit(0.0)) > g for g in GRID]
    is_true = F.coalesce(F.col("true"), F.lit(False))
    sums = both.groupBy("subject").agg(*[
        (2 * F.count_if(x & is_true) / F.greatest(F.lit(1), F.count_if(x) + F.count_if(is_true))).alias(f"f{i}") for i, x in enumerate(said)
    ])
    return {r.subject: max(zip((r[f"f{i}"] for i in range(len(GRID))), (-i for i in range(len(GRID))), GRID, strict=True))[2] for r in sums.collect()}


def assign_subjects(documents: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, subject, score)`` for every subject whose score exceeds its threshold; documents can have several or none.

    With ``labels``, terms are learned and thresholds calibrated; without, curated terms are all there are.
    """
    terms = curated()
    if labels is not None:
        terms = terms + learned_terms(documents, labels, key, text, {t for t, _, _ in terms})
    scores = subject_scores(documents, key, text, terms)
    thresholds = calibrated(scores, labels, key) if labels is not None else {}
    bar = F.lit(THRESHOLD)
    for subject, value in sorted(thresholds.items()):
        bar = F.when(F.col("subject") == subject, F.lit(value)).otherwise(bar)
    return scores.where(F.col("score") > bar)
