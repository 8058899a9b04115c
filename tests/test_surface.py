from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom import cli, server
from ledgerloom.api import Engine, compare, report
from ledgerloom.functions import columns as fn
from ledgerloom.operators import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine.over(spark, FOLDER, lambda q: fn.nibbles(q, 64), 1)


def test_search_ask_and_lookup(spark, engine):
    text = engine.corpus.where("embedding is not null").orderBy("chunk_id").first()
    asked = spark.createDataFrame([(1, text.text[:200]), (2, "What does Zeta Motors sell?")], "question_id long, query string")
    hits = engine.search(asked, 5, "hybrid")
    assert hits.where("question_id = 1").count() == 5 and {r.rank for r in hits.collect()} == {1, 2, 3, 4, 5}
    assert engine.search(asked, 500, "vector").where("question_id = 1").count() <= 20
    narrow = engine.search(asked, 10, "vector", form_type="10-k", after=True)
    assert {r.form_type for r in narrow.collect()} <= {"10-K"}
    answers = {r.question_id: r for r in engine.ask(asked).collect()}
    assert set(answers) == {1, 2} and answers[2].route == "out_of_scope" and answers[2].refused and answers[2].retrieved_chunk_ids == []
    one = engine.get_chunk(text.chunk_id).first()
    assert one.chunk_id == text.chunk_id and engine.get_chunk(-1).isEmpty()
    assert engine.list_companies().count() > 0
    # a company by any of its spellings
    name = engine.documents.where("company is not null").orderBy("doc_id").first()
    assert engine.company_number(name.company.upper()) == engine.company_number(name.cik) == str(int(name.cik)) and engine.company_number("Nobody & Sons") == "Nobody & Sons"
    own = engine.search(asked, 5, "vector", company=name.company)
    assert {r.company for r in own.collect()} <= {str(int(name.cik))}


def test_runs_are_logged_in_order(spark, engine, tmp_path):
    store = catalog.Store(spark, str(tmp_path))
    asked = spark.createDataFrame([(1, "What does Zeta Motors sell?"), (2, "And Omega Planes?")], "question_id long, query string")
    for n in (2, 4):
        catalog.log_runs(store, asked, engine.ask(asked), 1, "hybrid", 5.0)
        rows = store.read("query_runs").orderBy("run_id").collect()
        assert [r.run_id for r in rows] == list(range(1, n + 1)) and all(r.refused for r in rows)


def test_schema_drift_is_an_error(spark, tmp_path):
    store = catalog.Store(spark, str(tmp_path))
    assert catalog.check_schemas(store, {"a": "x int", "b": "y int"}) == ["a", "b"]
    assert catalog.check_schemas(store, {"a": "x  int", "c": "z int"}) == ["c"]
    with pytest.raises(ValueError, match="'a'"):
        catalog.check_schemas(store, {"a": "x long"})


def test_evaluation_report(spark, engine):
    spec = "question_id string, spec_id string, company string, form_type string, accession string, section_prefix string, must_contain string"
    asked = spark.createDataFrame([("a", "revenue goodwill", "single_fact", False, "all"), ("b", "x", "out_of_corpus", True, "all")], "question_id string, query string, type string, refuse boolean, require string")
    specs = spark.createDataFrame([("a", "a#0", None, None, None, None, "goodwill")], spec)
    for mode in ("text", "agent"):
        made = engine.evaluate(asked, specs, mode)
        assert made.count() == 2
    both = compare({"one": engine}, ["text", "vector"], asked, specs)
    assert sorted((r.name, r.mode, r.questions) for r in both.collect()) == [("one", "text", 2), ("one", "vector", 2)]
    text = report("text", engine.evaluate(asked, specs, "text"), ["single_fact", "out_of_corpus"])
    assert "recall_at_5" in text and "| 0.40 |" in text and "## Misses" in text


def test_command_line(capsys, tmp_path):
    assert cli.main(["version"]) == 0 and cli.main(["export-graph"]) == 0 and "[grade] --> " in capsys.readouterr().out
    assert cli.main(["--data", FOLDER, "check"]) == 0
    assert '"documents": ' in capsys.readouterr().out
    assert cli.main(["--data", FOLDER, "get-chunk", "-5"]) == 1
    golden = tmp_path / "g.yaml"
    golden.write_text("- {id: a, type: single_fact, question: q, expected: [{must_contain: nothing-like-this}]}\n")
    assert cli.main(["--data", FOLDER, "check-golden", str(golden)]) == 1


def test_service(spark, engine, tmp_path):
    runs = spark.read.parquet(f"{FOLDER}/query_runs.parquet")
    s = server.Service(spark, engine, runs, most=3)
    assert s.handle("GET", "/health", b"", "a")[0] == 200
    told = s.handle("GET", "/metrics", b"", "a")[1]
    assert told["queries"] > 0 and 0 <= told["refusal_rate"] <= 1 and told["p50_ms"] <= told["p95_ms"]
    assert server.metrics(runs.where(F.lit(False))) == {"queries": 0, "refusal_rate": 0.0, "p50_ms": 0.0, "p95_ms": 0.0}
    bad = [b"{", b'{"question": "ab"}', json.dumps({"question": "x" * 501}).encode(), b'{"question": "fine one", "k": 21}']
    assert [s.handle("POST", "/query", b, "c", 0.0)[0] for b in bad] == [422, 422, 422, 429]
    # with a store, every question is logged and counts
    logging = server.Service(spark, engine, runs, store=catalog.Store(spark, str(tmp_path)))
    assert logging.handle("POST", "/query", b'{"question": "What does Zeta Motors sell?"}', "e", 0.0)[0] == 200
    assert logging.handle("GET", "/metrics", b"", "a")[1]["queries"] == told["queries"] + 1
    status, out = s.handle("POST", "/query", b'{"question": "What does Zeta Motors sell?"}', "d", 0.0)
    assert status == 200 and out["refused"] and s.handle("GET", "/nope", b"", "a")[0] == 404
