from __future__ import annotations

import datetime as d
import urllib.error

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import catalog, chunking, quantiles, routing
from ledgerloom.sources import client, files
from ledgerloom.streaming import streams


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(3, 30))
def test_recursive_spans_cover_the_text(text, most):
    s = chunking.Recursive(most, 1)
    spans = s.spans(text, [])
    assert "".join(text[a:b] for a, b in spans) == text
    assert all(s.tokenizer.count(text[a:b]) <= most * 1.1 + 1 for a, b in spans)
    assert [c[0] for c in s.split(text)] == list(range(len(s.split(text))))


def test_chunkers(spark):
    words = " ".join(f"w{i}" for i in range(300))
    fixed = chunking.Fixed(120, 40, 5).split(words)
    assert [c[3] for c in fixed] == [120, 120, 120, 60] and fixed[1][1].split()[:40] == fixed[0][1].split()[-40:]
    regions = [chunking.Region("Item 1.", 0, 500), chunking.Region("Item 2.", 500, len(words))]
    aware = chunking.SectionAware(50, 1).split(words, regions)
    assert {c[2] for c in aware} == {"Item 1.", "Item 2."} and all(c[3] <= 50 for c in aware)
    with pytest.raises(ValueError):
        chunking.Fixed(10, 10)
    with pytest.raises(ValueError):
        chunking.get_strategies(["nope"])
    docs = spark.createDataFrame([("a", words, 1), ("b", None, 2), ("c", "  ", 3)], "accession_no string, text string, ordinal int")
    made = chunking.chunk(docs, chunking.get_strategies(most=100))
    assert {r.document_id for r in made.collect()} == {"a"} and {r.strategy for r in made.collect()} == {"fixed", "recursive", "section_aware"}


def test_store_upsert_and_embedding_twice(spark, tmp_path):
    store = catalog.Store(spark, str(tmp_path))
    index = catalog.Index(store)
    provider = catalog.HashProvider()
    store.append("chunk_param_sets", spark.createDataFrame([("s", "p", "{}")], "strategy string, params_hash string, params string"))
    rows = [(1, "d", "s", "p", 0, "one", "h1"), (2, "d", "s", "p", 1, "two", "h2"), (3, "d", "s", "p", 2, "one", "h1")]
    store.append("chunks", spark.createDataFrame(rows, "chunk_id long, document_id string, strategy string, params_hash string, ordinal int, text string, content_hash string"))
    with pytest.raises(LookupError):
        index.get_or_create(provider, "s", "other")
    v = index.get_or_create(provider, "s", "p")
    assert index.get_or_create(provider, "s", "p") == v == 1
    assert index.embed_pending(provider, v) == {"embedded": 2, "already_present": 0}
    assert index.embed_pending(provider, v) == {"embedded": 0, "already_present": 2}
    ready = catalog.latest_ready(index.versions()).first()
    assert ready.status == "ready" and ready.chunk_count == 2
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, name string")
    new = spark.createDataFrame([("b", 9, "z"), ("c", 3, "w")], "k string, n int, name string")
    assert sorted(map(tuple, catalog.upsert(old, new, "k", ["n"]).collect())) == [("a", 1, "x"), ("b", 9, "y"), ("c", 3, "w")]
    assert [r.k for r in catalog.insert_ignore(old, new, ["k"]).collect()] == ["c"]
    store.append("t", spark.createDataFrame([(1, "p"), (2, "q")], "n int, part string"), ["part"])
    store.replace_partition("t", {"part": "p"}, spark.createDataFrame([(5,)], "n int"))
    assert sorted((r.n, r.part) for r in store.read("t").collect()) == [(2, "q"), (5, "p")]


@pytest.mark.parametrize("dies_at", range(4))
def test_a_replacement_that_dies_is_ended_by_the_next_reader(spark, tmp_path, dies_at):
    store = catalog.Store(spark, str(tmp_path))
    store.replace("t", spark.range(10))
    store.append("p", spark.createDataFrame([(1, "a"), (2, "b")], "n int, part string"), ["part"])
    steps = [0]

    class Dying:
        """The file system, which fails at one of the deletions and renames."""

        def __getattr__(self, name):
            def call(*args):
                if name in ("rename", "delete"):
                    steps[0] += 1
                    if steps[0] == dies_at + 1:
                        raise RuntimeError("died")
                return getattr(fs, name)(*args)

            return call

    fs, dying = store._fs, catalog.Store(spark, str(tmp_path))
    dying._fs = Dying()
    with pytest.raises(RuntimeError):
        dying.replace("t", spark.range(3))
    rows = catalog.Store(spark, str(tmp_path)).read("t", "id long").count()
    assert rows == (10 if dies_at < 2 else 3)
    steps[0] = 0
    with pytest.raises(RuntimeError):
        dying.replace_partition("p", {"part": "a"}, spark.createDataFrame([(7,)], "n int"))
    assert sorted((r.n, r.part) for r in store.read("p").collect()) == [(1 if dies_at < 2 else 7, "a"), (2, "b")] or dies_at >= 2
    assert sorted((r.n, r.part) for r in store.read("p").collect()) in ([(1, "a"), (2, "b")], [(2, "b"), (7, "a")])
    store.replace("t", store.read("t").limit(2))
    assert store.read("t").count() == 2


def test_select_and_classify_filings(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"cik": 7, "name": "Mini", "filings": {"recent": {"accessionNumber": ["a1","a2","a3","a4","a5"], "form": ["10-K","10-q","8-K","10-K","10-Q"], "filingDate": ["2025-01-31","2024-10-01","2024-09-01","2024-01-31","2024-07-01"], "reportDate": ["2024-12-31","","","2023-12-31","2024-06-30"], "primaryDocument": ["a.htm","b.htm","c.htm","d.htm","e.htm"]}}}')
    got = catalog.select_filings(files.submissions(spark, str(path)), ["10-K", "10-Q"], 1)
    assert {(r.accession_no, r.form_type) for r in got.collect()} == {("a1", "10-K"), ("a2", "10-Q")} and got.where("accession_no = 'a2'").first().period is None
    path.write_text('{"cik": 7, "name": "Mini", "filings": {"recent": {"accessionNumber": ["a1","a2"], "form": ["10-K"], "filingDate": ["2025-01-31"], "reportDate": [""], "primaryDocument": ["a"]}}}')
    with pytest.raises(Exception, match="differ in length"):
        catalog.select_filings(files.submissions(spark, str(path)), ["10-K"], 1).collect()
    filings = spark.createDataFrame([("a",), ("b",), ("c",)], "accession_no string")
    known = spark.createDataFrame([("a", "pa"), ("b", "pb")], "accession_no string, raw_path string")
    there = spark.createDataFrame([("pa",)], "raw_path string")
    assert {r.accession_no: r.action for r in catalog.classify_ingest(filings, known, there).collect()} == {"a": "skipped", "b": "refreshed", "c": "downloaded"}


def test_golden_and_settings(tmp_path, spark):
    good = [{"id": "a", "type": "single_fact", "question": "q", "expected": [{"company": "A"}]}, {"id": "b", "type": "out_of_corpus", "question": "q", "refuse": True}]
    assert len(files.checked_golden(good)) == 2
    for bad in ([good[0], good[0]], [{**good[0], "type": "x"}], [{**good[0], "require": "some"}], [{**good[1], "expected": [{}]}]):
        with pytest.raises(ValueError):
            files.checked_golden(bad)
    assert files.Settings.read({"LEDGERLOOM_MAX_RPS": "5"}).max_rps == 5
    with pytest.raises(ValueError, match="MAX_RPS.*") as e:
        files.Settings.read({"LEDGERLOOM_MAX_RPS": "x", "LEDGERLOOM_USER_AGENT": "nobody"})
    assert "USER_AGENT" in str(e.value)
    (tmp_path / "a.md").write_text("old")
    assert files.latest_report(spark, str(tmp_path)).first().report == "old"
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "x.htm").write_bytes("é".encode("cp1252"))
    row = files.raw_files(spark, str(tmp_path / "raw")).first()
    assert row.text == "é" and row.size_bytes == 1


def test_client_retries():
    answers = iter([(503, {}, b""), (429, {"Retry-After": "99"}, b""), (200, {}, b"ok")])
    waits = []
    c = client.Client("me me@x.example", 1000, lambda u, h: next(answers), waits.append)
    put = {}
    assert c.download("u", "f", put.__setitem__)[1] == 2 and max(waits) == 60 and put == {"f": b"ok"}
    with pytest.raises(urllib.error.HTTPError):
        client.Client("m", 1000, lambda u, h: (404, {}, b""), waits.append).get("u")
    tries = []
    with pytest.raises(urllib.error.HTTPError):
        client.Client("m", 1000, lambda u, h: tries.append(1) or (500, {}, b""), lambda s: None).get("u")
    assert len(tries) == 6 and client.backoff(10, jitter=lambda: 0.5) == 60.5 and client.submissions_url("https://x", "42").endswith("CIK0000000042.json")
    now = [0.0]
    t = client.Throttle(2, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    t.wait(), t.wait(), t.wait()
    assert now[0] == 1.0


def test_routing(spark):
    docs = spark.createDataFrame([("007", "Acme Tools Inc."), ("7", "ACME TOOLS, INC"), ("8", "Borealis Foods plc"), (None, "Nobody Corp"), ("9", None)], "cik string, company string")
    asked = spark.createDataFrame(
        [(1, "What did Acme Tools say about risk?"), (2, "How did Borealis Foods revenue change between 2023 and 2024?"), (3, "Compare Acme Tools and Borealis Foods."), (4, "What does Zeta Motors sell?"), (5, "what are the risk factors in the annual report?"), (6, ""), (7, None)], "question_id long, query string"
    )
    got = {r.question_id: r for r in routing.planned(asked, routing.company_aliases(docs)).collect()}
    assert [got[i].route for i in (1, 2, 3, 4, 5, 6)] == ["lookup", "temporal", "comparison", "out_of_scope", "lookup", "lookup"]
    assert got[3].companies == ["7", "8"] and got[5].form_type == "10-K" and 7 in got


def test_grades(spark):
    rows = [
        (1, "lookup", ["A"], [], 0.7, ["A"]), (2, "lookup", [], [], 0.7, ["A"]), (3, "lookup", ["A"], [], 0.7, ["B"]), (4, "lookup", [], [], 0.9, []), (5, "out_of_scope", [], ["Zeta"], 0.9, ["A"]),
    ]
    df = spark.createDataFrame(rows, "question_id long, route string, companies array<string>, unknown array<string>, top_vector_score double, hit_companies array<string>")
    got = {r.question_id: r for r in routing.graded(df).collect()}
    assert [got[i].graded_ok for i in range(1, 6)] == [True, False, False, False, False]
    assert "below bar 0.75" in got[2].reason and "no chunks" in got[4].reason and "Zeta" in got[5].reason


def test_quantiles_are_exact(spark):
    import random

    rng = random.Random(1)
    data = [("a", rng.choice([0.0, -3.5, 2.25, rng.lognormvariate(3, 2)])) for _ in range(2000)] + [("b", 5.0), (None, 1.0), (None, 4.0), ("c", None), ("c", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r for r in quantiles.nearest_rank(df, ["g"], "v", {"p50": 50, "p99": 99}).collect()}
    own = sorted(v for g, v in data if g == "a")
    assert (got["a"].p50, got["a"].p99) == (own[999], own[1979]) and got["b"].p50 == 5.0 and got[None].p50 == 1.0 and "c" not in got
    mid = {r.g: r for r in quantiles.continuous(df, ["g"], "v", {"p50": 50}).collect()}
    assert abs(mid["a"].p50 - (own[999] + own[1000]) / 2) < 1e-9 and mid[None].p50 == 2.5
    one_hundred = spark.createDataFrame([("x", float(i)) for i in range(1, 101)], "g string, v double")
    assert quantiles.nearest_rank(one_hundred, ["g"], "v", {"p50": 50, "p95": 95}).first()[2:] == (50.0, 95.0)


def test_limiter_batch_equals_stream(spark, tmp_path):
    base = d.datetime(2026, 1, 1)
    rows = [(c, i, base + d.timedelta(seconds=s)) for c in ("a", "b") for i, s in enumerate([0, 1, 2, 3, 59, 60, 61, 62, 121])]
    df = spark.createDataFrame(rows, "client string, hit_id long, ts timestamp")
    batch = {(r.client, r.hit_id): r.allowed for r in streams.limited(df, 3, 60.0).collect()}
    assert [batch["a", i] for i in range(9)] == [True, True, True, False, False, False, True, True, True]
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.limited_stream(source, 3, 60.0).writeStream.format("memory").queryName("allowed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.client, r.hit_id): r.allowed for r in spark.table("allowed").collect()} == batch


def test_embedding_stream_adds_nothing_twice(spark, tmp_path):
    store = catalog.Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "h1", "x"), (2, "h2", "y"), (3, "h1", "x")], "chunk_id long, content_hash string, text string")
    rows.write.parquet(str(tmp_path / "in"))
    for cp in ("one", "two"):
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        streams.embed_arrivals(source, store, catalog.HashProvider(), "v", str(tmp_path / cp)).awaitTermination()
    assert sorted(r.content_hash for r in store.read("v").collect()) == ["h1", "h2"]


def test_queries_have_the_oracles_columns(spark):
    import __spark_entry__ as e

    folder = "/root/testdata/sf0.001"
    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns == ["item_id", "chunk_id", "rank", "score"] and df.count() > 0
    assert e.queries()["embed_pending"](spark, folder).where(F.col("content_hash").isNull()).count() == 0


def test_aliases_of_any_length_are_found(spark):
    long = "the first national bank of the greater northern lakes region"
    aliases = spark.createDataFrame([(long, "7", 7), ("acme", "8", 8)], "alias string, company string, nth long")
    questions = spark.createDataFrame([(1, f"What did {long} earn?"), (2, "What did Acme earn?"), (3, "Who?")], "question_id long, query string")
    got = {r.question_id: r.companies for r in routing.detect_companies(questions, aliases).collect()}
    assert got == {1: ["7"], 2: ["8"], 3: []}
    assert all(not r.companies for r in routing.detect_companies(questions, aliases.limit(0)).collect())
