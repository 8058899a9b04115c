from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import incremental as inc

CHUNK = "chunk_id long, document_id string, strategy string, params_hash string, ordinal int, content_hash string, run_id long, status string"
MANIFEST = "run_id long, document_id string, strategy string, params_hash string, ordinal int, content_hash string, processed_at timestamp, chunk_id long"
RUNS = "run_id long, started_at timestamp, finished_at timestamp, status string"


def numbers(df, c="n"):
    return sorted(r[0] for r in df.select(c).collect())


def frame(spark, values, name="n"):
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


@pytest.mark.parametrize("seed", range(3))
def test_gaps_are_the_set_difference(spark, seed):
    rng = random.Random(seed)
    have = [rng.randrange(-70_000, 140_000) for _ in range(3000)]
    done = rng.sample(have, 1500) + [rng.randrange(200_000) for _ in range(200)]
    got = numbers(inc.pending(frame(spark, [*have, None]), frame(spark, [*done, None]), "n"))
    assert got == sorted(set(have) - set(done))


def test_intervals_are_disjoint_and_merge(spark):
    a = inc.to_intervals(frame(spark, [1, 2, 3, 3, 7, 65_535, 65_536]), "n")
    assert sorted(map(tuple, a.collect())) == [(0, 1, 3), (0, 7, 7), (0, 65_535, 65_535), (1, 65_536, 65_536)]
    b = inc.to_intervals(frame(spark, [4, 5, 9]), "n")
    assert sorted(map(tuple, inc.merge_intervals(a, b).collect()))[:3] == [(0, 1, 5), (0, 7, 7), (0, 9, 9)]


def test_empty_inputs(spark):
    none = frame(spark, [])
    assert numbers(inc.pending(none, none, "n")) == []
    assert numbers(inc.pending(frame(spark, [5]), none, "n")) == [5]
    assert numbers(inc.pending(none, frame(spark, [5]), "n")) == []


def ts(n):
    import datetime as d

    return d.datetime(2026, 1, 1, tzinfo=d.UTC) + d.timedelta(hours=n)


def test_pending_chunks_cases(spark):
    runs = spark.createDataFrame([(1, ts(1), None, "succeeded"), (2, ts(9), None, "failed"), (3, ts(5), None, "succeeded"), (4, ts(20), None, "running"), (9, ts(3), None, "succeeded")], RUNS)
    rows = [
        (1, "0-1", "s", "p", 0, "aa"),  # seen, spelled otherwise
        (2, "0-1", "s", "p", 1, "bb"),  # only a failed run saw it
        (3, "0-1", "s", "p", 2, "cc"),  # the latest successful run saw another hash
        (4, "0-1", "s", "p", 3, "dd"),  # an earlier run saw another hash, the latest this one
        (5, "0-1", "s", "p", 4, "ee"),  # never seen
        (6, None, "s", "p", 5, "ff"),  # null key, seen as null
        (7, "0-1", "s", "p", 7, None),  # null hash, seen with a hash
        (None, "0-1", "s", "p", 8, "xx"),  # null number
    ]
    chunks = spark.createDataFrame([(*r, 77, "clash") for r in rows], CHUNK)
    seen = [
        (1, "01", "s", "p", 0, " AA ", ts(2)), (1, "01", "s", "p", 0, "aa", ts(2)), (2, "0-1", "s", "p", 1, "bb", ts(9)), (1, "0-1", "s", "p", 2, "cc", ts(30)), (3, "01", "s", "p", 2, "zz", ts(6)),
        (9, "01", "s", "p", 3, "yy", ts(40)), (3, "0-1", "s", "p", 3, "DD", ts(6)), (4, "0-1", "s", "p", 4, "ee", ts(21)), (1, None, "s", "p", 5, "ff", ts(2)), (1, "0-1", "s", "p", 7, "gg", ts(2)), (1, "gone", "s", "p", 0, "a", ts(2)),
    ]
    manifest = spark.createDataFrame([(*r, 1) for r in seen], MANIFEST)
    assert numbers(inc.pending_chunks(chunks, manifest, runs), "chunk_id") == [2, 3, 5, 7]
    assert numbers(inc.pending_chunks(chunks.limit(0), manifest, runs), "chunk_id") == []
    assert numbers(inc.pending_chunks(chunks, manifest.limit(0), runs.limit(0)), "chunk_id") == [1, 2, 3, 4, 5, 6, 7]


def test_runs_commit_output_and_intervals_together(spark, tmp_path):
    run = inc.IncrementalRun(spark, str(tmp_path / "ledger"))
    first = spark.createDataFrame([(1, "a"), (2, "b"), (5, "e")], "n long, v string")
    assert run.run(first, "n", lambda d: d.withColumn("v", F.upper("v"))) == 0
    assert run.run(first, "n", lambda d: d) == -1
    more = first.unionByName(spark.createDataFrame([(3, "c"), (9, "i")], "n long, v string"))

    def fails(_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run.run(more, "n", fails)
    assert run.commits() == [0]
    assert run.run(more, "n", lambda d: d) == 1  # 3 came late, and isn't skipped
    assert sorted(map(tuple, run.output().select("n", "v").collect())) == [(1, "A"), (2, "B"), (3, "c"), (5, "E"), (9, "i")]
    assert numbers(inc.numbers_in(run.processed())) == [1, 2, 3, 5, 9]


def test_changed_records_are_processed_again(spark, tmp_path):
    run = inc.IncrementalRun(spark, str(tmp_path / "ledger"))
    rows = lambda *x: spark.createDataFrame(list(x), "n long, v string")
    assert run.run(rows((1, "a"), (2, "b"), (None, "x")), "n", lambda d: d, "v") == 0
    assert run.run(rows((1, "a"), (2, "b")), "n", lambda d: d, "v") == -1
    assert run.run(rows((1, "A"), (2, "b"), (4, "d")), "n", lambda d: d, "v") == 1
    assert run.run(rows((1, "A"), (2, "b"), (4, "d")), "n", lambda d: d, "v") == -1
    assert run.run(rows((1, "a"), (2, None)), "n", lambda d: d, "v") == 2
    assert sorted(map(tuple, run.output().collect()), key=str) == [(1, "A"), (1, "a"), (1, "a"), (2, "b"), (2, None), (4, "d")]
    assert numbers(inc.numbers_in(run.processed())) == [1, 2, 4]


def test_racing_runs_and_deaths_lose_and_repeat_nothing(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    one, two = inc.IncrementalRun(spark, folder), inc.IncrementalRun(spark, folder)
    few, many = frame(spark, [0, 1]), frame(spark, [0, 1, 2, 3, 4])

    def overtaken(todo):
        assert two.run(many, "n", lambda d: d) == 0  # the other commits while this one works
        return todo

    with pytest.raises(FileExistsError):
        one.run(few, "n", overtaken)
    assert numbers(one.output()) == [0, 1, 2, 3, 4] and one.run(many, "n", lambda d: d) == -1
    more = frame(spark, [0, 1, 2, 3, 4, 5, 9])
    for step in ("process", "_numbers", "_claim"):
        dying = inc.IncrementalRun(spark, folder)

        def dies(*_):
            raise RuntimeError("died")

        if step != "process":
            setattr(dying, step, dies)
        with pytest.raises(RuntimeError):
            dying.run(more, "n", dies if step == "process" else lambda d: d)
        assert numbers(one.output()) == [0, 1, 2, 3, 4]
    # a marker without content is of a run that died while it committed
    (tmp_path / "ledger" / "commits" / "1").touch()
    assert one.run(more, "n", lambda d: d) == 2 and one.commits() == [0, 2]
    assert numbers(one.output()) == [0, 1, 2, 3, 4, 5, 9]
    with pytest.raises(FileExistsError):
        one._claim(2, "x 0")
