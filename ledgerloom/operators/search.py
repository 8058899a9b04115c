"""Ranked retrieval for batches of questions: vectors, full text, fusion and fan-out.

Questions are a stated query set. Each has one or more *legs*: a filter (a company, a filing, or none) with
a number of hits. Legs go to the workers in blocks; the chunks are read once for a block, each task keeps
its best rows of each leg, and only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import english
from ledgerloom.session import spread

#: Legs that go to the workers at once.
BLOCK = 2_000
POOL, RRF_K = 50, 60
#: Decimals that scores are compared at, so that rounding in the last bits doesn't order hits.
DIGITS = 9

LEG = "leg long, question_id {kind}, vector array<double>, query string, company string, document_id string"


def ranked(hits: DataFrame, by: list[str], score: str, *ties: Column | str, most: int | Column | None = None, name: str = "rank") -> DataFrame:
    """``hits`` numbered from 1 within ``by``, best score first; with ``most``, only so many."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    out = hits.withColumn(name, F.row_number().over(order))
    return out if most is None else out.where(F.col(name) <= most)


def single_legs(questions: DataFrame) -> DataFrame:
    """One leg without a filter for each question ``(question_id, query, vector)``."""
    nothing = F.lit(None).cast("string")
    return questions.select("question_id", "query", "vector", F.lit(0).alias("nth"), nothing.alias("company"), nothing.alias("document_id"))


class _Block:
    """Legs of one block as arrays. Filters are by value, so a task needs one mask for each distinct one."""

    def __init__(self, rows: list):
        self.keys = [(r.question_id, r.nth) for r in rows]
        self.filters = [(r.company, r.document_id) for r in rows]
        self.queries = [english.parse_query(r.query or "") for r in rows]
        self.beginnings: ahocorasick.Automaton | None = None  # made where it's needed
        vectors = [r.vector for r in rows]
        size = next((len(v) for v in vectors if v), 0)
        matrix = np.array([v if v and len(v) == size else [np.nan] * size for v in vectors], dtype=float).reshape(len(rows), size)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        self.matrix = np.divide(matrix, norms, out=np.full_like(matrix, np.nan), where=norms > 0)


def _blocks(legs: DataFrame) -> Iterator[_Block]:
    rows: list = []
    for r in legs.select("question_id", "nth", "query", "vector", "company", "document_id").toLocalIterator():
        rows.append(r)
        if len(rows) == BLOCK:
            yield _Block(rows)
            rows = []
    if rows:
        yield _Block(rows)


def _best(found: dict[int, list[np.ndarray]], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for leg, parts in found.items():
        ids, scores = np.concatenate(parts[0::2]), np.concatenate(parts[1::2])
        order = np.lexsort((ids, -np.round(scores, DIGITS)))[:most]
        yield leg, ids[order], scores[order]


def _leg_hits(chunks: DataFrame, legs: DataFrame, most: int, score: Callable) -> DataFrame:
    """``(question_id, nth, chunk_id, score, rank)``: the best ``most`` chunks of each leg.

    ``score(block, batch)`` gives ``(leg, row numbers, scores)`` of a batch of ``(chunk_id, company, document_id, content)``.
    """
    kind = dict(legs.dtypes)["question_id"]
    schema = f"question_id {kind}, nth int, chunk_id long, score double"
    parts = []
    for block in _blocks(legs):
        sent = chunks.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            found: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column(0).to_numpy()
                for leg, rows, scores in score(own, batch):
                    kept = found.setdefault(leg, [])
                    kept.extend((ids[rows], scores))
                    if sum(map(len, kept[0::2])) > 8 * most:
                        found[leg] = [x for _, i, s in _best({leg: kept}, most) for x in (i, s)]
            for leg, i, s in _best(found, most):
                question, nth = own.keys[leg]
                yield pa.RecordBatch.from_arrays([pa.array([question] * len(i)), pa.array([nth] * len(i), pa.int32()), pa.array(i), pa.array(s)], names=["question_id", "nth", "chunk_id", "score"])

        parts.append(chunks.mapInArrow(search, schema))
    if not parts:
        parts = [chunks.sparkSession.createDataFrame([], schema)]
    hits = reduce(DataFrame.unionByName, parts).withColumn("at", F.round("score", DIGITS))
    return ranked(hits, ["question_id", "nth"], "at", "chunk_id", most=most).drop("at")


def _masks(block: _Block, batch: pa.RecordBatch) -> dict[tuple, np.ndarray | None]:
    company, document = batch.column(1), batch.column(2)
    out: dict[tuple, np.ndarray | None] = {(None, None): None}
    values = [np.array(c.to_pylist(), dtype=object) for c in (company, document)] if any(f != (None, None) for f in block.filters) else []
    for f in set(block.filters) - {(None, None)}:
        mask = np.ones(batch.num_rows, bool)
        for want, have in zip(f, values, strict=True):
            if want is not None:
                mask &= have == want
        out[f] = mask
    return out


def _vector_scores(block: _Block, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    size = block.matrix.shape[1]
    column = batch.column(3)
    good = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == size)
    if not size or not len(good):
        return
    x = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    norms = np.linalg.norm(x, axis=1)
    fine = np.isfinite(norms) & (norms > 0)
    good, x = good[fine], x[fine] / norms[fine][:, None]
    masks = _masks(block, batch)
    for low in range(0, len(block.keys), 64):
        scores = x @ block.matrix[low : low + 64].T
        for i in range(scores.shape[1]):
            if np.isnan(block.matrix[low + i, 0]):
                continue
            mask = masks[block.filters[low + i]]
            rows = np.arange(len(good)) if mask is None else np.flatnonzero(mask[good])
            if len(rows):
                yield low + i, good[rows], scores[rows, i]


def vector_hits(chunks: DataFrame, legs: DataFrame, most: int) -> DataFrame:
    """The nearest chunks of each leg by cosine. ``chunks``: ``(chunk_id, company, document_id, embedding)``.

    Vectors of another dimension than the questions', with NaN or zero take no part; neither do questions
    without a vector. Equal scores go by ``chunk_id``.
    """

    def best(block: _Block, batch: pa.RecordBatch) -> Iterator:
        for leg, rows, scores in _vector_scores(block, batch):
            if len(rows) > 4 * most:
                kept = np.argpartition(-scores, most)[: 2 * most]
                # ties at the edge stay in
                edge = np.round(scores, DIGITS) >= np.round(np.partition(scores, -most)[-most], DIGITS)
                kept = np.union1d(kept, np.flatnonzero(edge))
                rows, scores = rows[kept], scores[kept]
            yield leg, rows, scores

    return _leg_hits(chunks.select("chunk_id", "company", "document_id", "embedding"), legs, most, best)


def _beginnings(stems: Iterable[str]) -> ahocorasick.Automaton:
    """What a word with one of the stems must begin with: stemming adds at most one letter to a word's beginning."""
    auto = ahocorasick.Automaton()
    for s in stems:
        auto.add_word(s[:-1] or s, None)
    auto.make_automaton()
    return auto


def text_hits(chunks: DataFrame, legs: DataFrame, most: int) -> DataFrame:
    """Chunks that match each leg's query in English full text, by cover density.

    ``chunks``: ``(chunk_id, company, document_id, text)``. A query without a word that carries meaning
    matches nothing. Texts are analysed whole, once for all legs of a block, and only those with a word that
    begins like the longest stem of some leg.
    """

    def score(block: _Block, batch: pa.RecordBatch) -> Iterator:
        needed = [frozenset(s for wanted, phrase in c if wanted for s, _ in phrase) for q in block.queries for c in q]
        owner = [i for i, q in enumerate(block.queries) for _ in q]
        by_rarest: dict[str, list[int]] = {}
        for n, stems in enumerate(needed):
            by_rarest.setdefault(max(stems, key=len), []).append(n)
        if not by_rarest:
            return
        masks = _masks(block, batch)
        if block.beginnings is None:
            block.beginnings = _beginnings(by_rarest)
        for row, text in enumerate(batch.column(3).to_pylist()):
            # most texts hold no word that could have one of the stems, and needn't be analysed
            if not text or next(block.beginnings.iter(text.lower()), None) is None:
                continue
            where: dict[str, list[int]] = {}
            for s, at in english.analyse(text):
                where.setdefault(s, []).append(at)
            # a leg is looked at if its longest stem stands in the text
            tried = {owner[n] for s in by_rarest.keys() & where.keys() for n in by_rarest[s] if needed[n] <= where.keys()}
            for leg in tried:
                mask = masks[block.filters[leg]]
                if (mask is None or mask[row]) and (value := english.rank(where, block.queries[leg])) is not None:
                    yield leg, np.array([row]), np.array([value])

    return _leg_hits(chunks.select("chunk_id", "company", "document_id", "text"), legs, most, score)


def simple_text_hits(chunks: DataFrame, questions: DataFrame, most: int) -> DataFrame:
    """Chunks with every word of a question, without stemming, by how often they have them; in the JVM only.

    Only chunks with the question's longest word, which is rare as a rule, are looked at for the others.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    asked = questions.select("question_id", F.array_sort(F.array_distinct(words(F.col("query")))).alias("asked")).where(F.size("asked") > 0)
    longest = F.array_max(F.transform("asked", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    asked = asked.withColumn("word", longest.w)
    rows = spread(chunks.select("chunk_id", "text")).select("chunk_id", words(F.col("text")).alias("words"))
    with_word = rows.withColumn("word", F.explode(F.array_distinct("words"))).join(asked, "word")
    every = with_word.where(F.forall("asked", lambda w: F.array_contains("words", w)))
    often = F.size(F.filter("words", lambda w: F.array_contains("asked", w))).cast("double")
    hits = every.select("question_id", F.lit(0).alias("nth"), "chunk_id", often.alias("score"))
    return ranked(hits, ["question_id"], "score", "chunk_id", most=most)


def fuse(lists: list[DataFrame], most: int, by: list[str] | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: each hit scores the sum of ``1 / (k + rank)``.

    Equal sums go to what comes first in the first list, then in the next.
    """
    by = by or ["question_id", "nth"]
    tagged = [df.select(*by, "chunk_id", "rank", F.lit(i).alias("list")) for i, df in enumerate(lists)]
    both = reduce(DataFrame.unionByName, tagged)
    sums = both.groupBy(*by, "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    sums = sums.withColumn("at", F.round("score", DIGITS + 3))
    return ranked(sums, by, "at", "first.list", "first.rank", most=most).drop("first", "at")


def hybrid_hits(chunks: DataFrame, legs: DataFrame, most: int, pool: int = POOL) -> DataFrame:
    """Fusion of the vector and the full-text list of each leg, each of ``pool`` hits.

    ``chunks`` has ``embedding`` and ``text``; also gives ``top_vector_score`` of the leg, 0 without a vector hit.
    """
    near = vector_hits(chunks.where("embedding is not null"), legs, pool)
    fused = fuse([near, text_hits(chunks, legs, pool)], most)
    top = near.where("rank = 1").select("question_id", "nth", F.col("score").alias("top_vector_score"))
    return fused.join(top, ["question_id", "nth"], "left").fillna(0.0, ["top_vector_score"])


def round_robin(hits: DataFrame, most: int) -> DataFrame:
    """Legs of each question merged in turn: first hits in order of legs, then second ones, and so on.

    A chunk keeps its first place; the merged list is cut at ``most`` and numbered anew.
    """
    first = hits.withColumn("turn", F.row_number().over(Window.partitionBy("question_id", "chunk_id").orderBy("rank", "nth"))).where("turn = 1")
    order = Window.partitionBy("question_id").orderBy("rank", "nth")
    out = first.withColumn("merged", F.row_number().over(order)).where(F.col("merged") <= most)
    return out.drop("turn", "rank").withColumnRenamed("merged", "rank")


def quota(k: int, legs: Column) -> Column:
    """Hits that each leg may bring."""
    return F.greatest(F.lit(2), F.floor(F.lit(k) / F.greatest(legs, F.lit(1)))).cast("int")


def fan_out(chunks: DataFrame, legs: DataFrame, k: int, mode: str = "hybrid") -> DataFrame:
    """Each question's legs searched on their own and merged in turn.

    Gives ``(question_id, chunk_id, rank, score, nth, top_vector_score)``; the last is the best over the legs.
    """
    found = search(chunks, legs, k, mode)
    count = legs.groupBy("question_id").agg(F.count(F.lit(1)).alias("legs"))
    within = found.join(count, "question_id").where(F.col("rank") <= quota(k, F.col("legs")))
    top = found.groupBy("question_id").agg(F.max("top_vector_score").alias("top_vector_score"))
    return round_robin(within.drop("legs", "top_vector_score"), k).join(top, "question_id")


def search(chunks: DataFrame, legs: DataFrame, k: int = 10, mode: str = "hybrid") -> DataFrame:
    """The ``k`` best chunks of each leg by ``mode``: vector, text or hybrid."""
    if mode == "hybrid":
        return hybrid_hits(chunks, legs, k)
    if mode == "vector":
        hits = vector_hits(chunks.where("embedding is not null"), legs, k)
        top = F.first("score").over(Window.partitionBy("question_id", "nth").orderBy("rank"))
        return hits.withColumn("top_vector_score", top)
    if mode == "text":
        return text_hits(chunks, legs, k).withColumn("top_vector_score", F.lit(0.0))
    raise ValueError(f"unknown mode {mode!r}: vector, text or hybrid")


def company_legs(questions: DataFrame) -> DataFrame:
    """A leg for each of a question's ``companies``, in their order."""
    return questions.select("question_id", "query", "vector", F.posexplode("companies").alias("nth", "company"), F.lit(None).cast("string").alias("document_id"))


def filing_legs(questions: DataFrame, documents: DataFrame, most: int = 4) -> DataFrame:
    """A leg for each of the newest filings of a question's first company, of the question's form if it names one.

    ``questions``: ``(question_id, query, vector, company, form_type)``.
    """
    filings = documents.select("company", F.col("form_type").alias("form"), "filing_date", F.col("accession_no").alias("document_id"))
    filings = filings.groupBy("company", "document_id").agg(F.max("filing_date").alias("filing_date"), F.max("form").alias("form"))
    own = questions.join(filings, "company").where("form_type is null or form = form_type")
    own = ranked(own, ["question_id"], "filing_date", "document_id", most=most, name="place")
    return own.select("question_id", "query", "vector", (F.col("place") - 1).alias("nth"), F.lit(None).cast("string").alias("company"), "document_id")


def corpus_companies(documents: DataFrame) -> DataFrame:
    """``(document_id, company, form_type)`` of each filing, once; the company is its number as text."""
    return documents.groupBy(F.col("accession_no").alias("document_id")).agg(
        F.min(F.regexp_replace("cik", "[^0-9]", "").cast("bigint")).cast("string").alias("company"), F.min(F.upper(F.trim("form_type"))).alias("form_type")
    )


def corpus(chunks: DataFrame, vectors: DataFrame, documents: DataFrame, strategy: str, params: str) -> DataFrame:
    """``(chunk_id, document_id, section, text, company, form_type, embedding)`` of the chunks of one set.

    The company is its number as text, so that spellings don't matter. Chunks without a vector stay, with null.
    """
    filings = corpus_companies(documents)
    own = chunks.where((F.col("strategy") == strategy) & (F.col("params_hash") == params)).select("chunk_id", "document_id", "section", "text", "content_hash")
    own = spread(own)
    return own.join(filings, "document_id").join(vectors.select("content_hash", "embedding"), "content_hash", "left").drop("content_hash")
