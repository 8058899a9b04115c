from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluation as ev
from ledgerloom.operators import search as s

CHUNKS = "chunk_id long, company string, document_id string, form_type string, section string, text string, embedding array<float>"


def legs(spark, rows):
    return spark.createDataFrame(rows, "question_id long, query string, vector array<double>, nth int, company string, document_id string")


@pytest.fixture
def chunks(spark):
    rows = [
        (1, "A", "d1", "10-K", "Item 1A. Risk", "Supply chain risk grew", [1.0, 0.0]),
        (2, "A", "d2", "10-Q", None, "supply of goods", [0.8, 0.6]),
        (3, "B", "d3", "10-K", "Item 1. Business", "chains supplied risk, supply chain risks", [0.8, 0.6]),
        (4, "B", "d3", "10-K", "", "", [0.0, 0.0]),
        (5, "B", "d3", "10-K", "Item 7", None, None),
        (6, None, "d4", "10-K", "Item 7", "other", [float("nan"), 1.0]),
        (7, "A", "d1", "10-K", "Item 8", "x", [1.0]),
    ]
    return spark.createDataFrame(rows, CHUNKS)


def test_vector_hits_ties_filters_and_bad_vectors(spark, chunks):
    asked = legs(spark, [(1, "", [2.0, 0.0], 0, None, None), (2, "", [2.0, 0.0], 0, "B", None), (3, "", None, 0, None, None), (4, "", [1.0, 0.0], 0, None, "d2")])
    got = sorted((r.question_id, r.rank, r.chunk_id, round(r.score, 6)) for r in s.vector_hits(chunks, asked, 2).collect())
    assert got == [(1, 1, 1, 1.0), (1, 2, 2, 0.8), (2, 1, 3, 0.8), (4, 1, 2, 0.8)]
    assert s.vector_hits(chunks.limit(0), asked, 2).count() == 0 and s.vector_hits(chunks, asked.limit(0), 2).count() == 0


def test_text_and_hybrid(spark, chunks):
    asked = legs(spark, [(1, "supply chain risk", [1.0, 0.0], 0, None, None), (2, "the", [0.0, 1.0], 0, None, None)])
    found = s.text_hits(chunks, asked, 5).collect()
    assert {r.chunk_id for r in found if r.question_id == 1} == {1, 3} and not [r for r in found if r.question_id == 2]
    top = s.search(chunks, asked, 3, "hybrid").where("question_id = 1 and rank = 1").first()
    assert top.chunk_id == 1 and abs(top.top_vector_score - 1) < 1e-9
    with pytest.raises(ValueError):
        s.search(chunks, asked, 3, "other")
    simple = s.simple_text_hits(chunks, asked.select("question_id", "query"), 5).orderBy("question_id", "rank").collect()
    assert [(r.question_id, r.chunk_id, r.score) for r in simple] == [(1, 1, 3.0), (1, 3, 3.0)]


def test_words_begin_like_their_stems(spark):
    # what text_hits passes texts over by
    from ledgerloom.functions import english

    words = {w for (t,) in spark.read.parquet("/root/testdata/sf0.001/chunks.parquet").select("text").collect() for w in english.WORD.findall((t or "").lower())}
    words |= set("relational sizing filing hopping happily valency conflated possibly vietnamization agreed operators falling companies dying skies".split())
    assert len(words) > 500 and all(w.startswith(english.stem(w)[:-1]) for w in words)


def test_fusion_prefers_the_first_list(spark):
    one = spark.createDataFrame([(1, 0, 10, 1), (1, 0, 20, 2)], "question_id long, nth int, chunk_id long, rank int")
    two = spark.createDataFrame([(1, 0, 30, 1), (1, 0, 20, 2)], "question_id long, nth int, chunk_id long, rank int")
    got = [r.chunk_id for r in s.fuse([one, two], 10).orderBy("rank").collect()]
    assert got == [20, 10, 30]


def test_round_robin(spark):
    hits = spark.createDataFrame([(1, leg, c, r, 0.5) for leg, own in enumerate([[1, 2, 3], [10, 1, 11]]) for r, c in enumerate(own, 1)], "question_id long, nth int, chunk_id long, rank int, score double")
    assert [(r.chunk_id, r.rank) for r in s.round_robin(hits, 4).orderBy("rank").collect()] == [(1, 1), (10, 2), (2, 3), (3, 4)]


def judgments(spark):
    j = "question_id string, type string, should_refuse boolean, refused boolean, specs int, hit1 int, hit5 int, hit10 int, first_rank int, dcg double, top_vector_score double, relevant_universe int"
    return spark.createDataFrame(
        [("a", "x", False, False, 1, 1, 1, 1, 1, 1.0, 0.9, 1), ("b", "x", False, False, 1, 0, 1, 1, 3, 0.5, 0.6, 1), ("c", "y", False, True, 1, 0, 0, 0, None, 0.0, 0.5, 0), ("d", "y", True, True, 0, 0, 0, 0, None, 0.0, 0.3, 0), ("e", "y", True, False, 0, 0, 0, 0, None, 0.0, 0.8, 0)], j
    )


def test_metrics(spark):
    j = judgments(spark)
    m = ev.summary(j).first()
    assert [round(m[f"recall_at_{k}"], 6) for k in (1, 5, 10)] == [0.333333, 0.666667, 0.666667]
    assert abs(m.mrr_at_10 - (1 + 1 / 3) / 3) < 1e-9 and abs(m.ndcg_at_10 - 0.5) < 1e-9
    assert m.refusal_precision == m.refusal_recall == 0.5
    empty = ev.summary(j.limit(0)).first()
    assert empty.recall_at_1 == 0 and empty.refusal_precision == 1
    assert ev.misses(j).first()[0] == "c"
    assert {r.threshold: r.refusal_recall for r in ev.sweep(j).collect()}[0.4] == 0.5
    assert ev.by_type(j, ["x", "y", "z"]).first().asDict() == {"x": 1.0, "y": 0.0, "z": None}
    best = spark.range(1).select(ev.ideal(F.lit(3)).alias("i")).first().i
    assert abs(best - (1 + 1 / 1.584962500721156 + 0.5)) < 1e-9


def test_specs(spark, chunks):
    spec = "question_id string, spec_id string, company string, form_type string, accession string, section_prefix string, must_contain string"
    specs = spark.createDataFrame([("q", "s1", "A", None, None, "Item 1", "SUPPLY"), ("q", "s2", None, None, "d3", None, None), ("r", "s3", None, None, None, None, "100%_x"), ("r", "s4", None, None, None, None, None)], spec)
    assert {r.spec_id: r.chunks for r in ev.universe(specs, chunks).collect()} == {"s1": 1, "s2": 3, "s3": 0, "s4": 0}
    assert {r.question_id: r.relevant_universe for r in ev.relevant_universe(specs, chunks).collect()} == {"q": 4, "r": 0}
    assert {r.spec_id for r in ev.dead_specs(specs, chunks).collect()} == {"s3", "s4"}
    asked = spark.createDataFrame([("q", "t", False, "all"), ("r", "t", True, "all")], "question_id string, type string, refuse boolean, require string")
    hits = spark.createDataFrame([("q", 3, 1, 0.9), ("q", 1, 2, 0.9)], "question_id string, chunk_id long, rank int, top_vector_score double")
    got = {r.question_id: r for r in ev.judged(asked, specs, hits, chunks, 0.68).collect()}
    assert (got["q"].specs, got["q"].hit1, got["q"].hit5, got["q"].first_rank, got["q"].refused) == (2, 1, 2, 1, False)
    assert got["r"].refused and got["r"].first_rank is None
    any_one = ev.judged(asked.withColumn("require", F.lit("any")), specs, hits, chunks, 0.68).where("question_id = 'q'").first()
    assert (any_one.specs, any_one.hit1, any_one.hit10) == (1, 1, 1)
