from __future__ import annotations

import datetime as d
import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import mix, percentiles as pc


def test_codes_keep_order_and_precision(spark):
    values = [0.0, 1e-9, 0.001, 1.0, 1.0005, 2.0, 3.999, 4.0, 4.0001, 1e6, 9.9e6, 1e300, 1.7e308, 3e-308, 5e-324, 2**53 - 1.0, *[random.Random(1).lognormvariate(3, 4) for _ in range(500)]]
    values = sorted([*values, *(-v for v in values)])
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    codes = [r.c for r in rows.select("v", pc.code(F.col("v")).alias("c")).orderBy("v").collect()]
    assert codes == sorted(codes) and min(codes) >= 0 and max(codes) < 2**pc.UNIVERSE
    for v, back in zip(values, pc.value_of(np.array(codes)), strict=True):
        assert abs(back - v) <= abs(v) / 511.9 if abs(v) >= 2.3e-308 else back == 0


def test_large_counters_keep_their_value():
    keys, sums = np.array([3, 9, pc.CELLS + 1]), np.array([5 * 2**40 + 1, -(3 * 2**33) - 7, 2])
    at, cells, counts = pc._unpacked(pc._packed(keys, sums, 3))
    back = pc._summed(at, cells, counts)
    assert back[0].tolist() == keys.tolist() and back[1].tolist() == sums.tolist()
    assert pc._unpacked(pc._packed(keys, sums, 3)[1:])[0].tolist() == [0]


def test_the_shape_follows_from_the_error():
    for error in (0.05, 0.01, 0.005, 0.001):
        width, levels = pc.shape(error)
        assert 16 * levels / width <= error and 2 ** (pc.UNIVERSE - levels) <= width * pc.DEPTH
    assert pc.rank_error(10**9) <= pc.ERROR * 10**9 + 1


def ranks_off(own, value, share):
    """How far the value's rank, as precise as codes are, is from the one asked for."""
    slack = abs(value) / 256
    low, high = np.searchsorted(own, value - slack, "left"), np.searchsorted(own, value + slack, "right")
    want = max(1, np.ceil(share * len(own)))
    return max(0, low + 1 - want, want - high)


def test_ranks_stay_within_the_stated_error():
    rng = np.random.default_rng(3)
    data = {
        "skewed": rng.lognormal(6, 3, 200_000), "negative": rng.normal(-50, 400, 200_000), "one value": np.full(50_000, 7.25), "wide": np.exp(rng.uniform(-600, 600, 200_000)) * rng.choice([-1, 1], 200_000),
        "heavy": np.concatenate((np.full(100_000, 3.0), np.full(60_000, -8.5), rng.normal(0, 1e9, 40_000))), "two": np.array([1.0, 2.0]),
    }
    shares = [0.001, 0.01, 0.25, 0.5, 0.9, 0.99, 0.999]
    for name, own in data.items():
        own = np.sort(own)
        exponent = np.floor(np.log2(np.abs(own)))
        steps = ((exponent - pc.LOWEST) * 256 + np.floor((np.abs(own) / 2.0**exponent - 1) * 256) + 1).astype(np.int64)
        codes, counts = np.unique(pc.ZERO + np.sign(own).astype(np.int64) * steps, return_counts=True)
        keys, sums = pc.add(np.zeros(len(codes), np.int64), codes, counts)
        found = pc.quantiles(keys, sums, 1, shares)[0]
        for share, value in zip(shares, found, strict=True):
            assert ranks_off(own, value, share) <= pc.rank_error(len(own)), (name, share, value)


def test_sketch_merges_and_deletes(spark):
    rng = random.Random(2)
    rows = [(day, "a" if rng.random() < 0.9 else "b", rng.choice([1, -1]) * rng.lognormvariate(6, 1.5)) for day in range(4) for _ in range(3000)]
    bad = [(0, "a", x) for x in (None, float("nan"), float("-inf"), float("inf"))] + [(9, "c", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows + bad + [(1, None, 4.0)]], "day int, g string, v double, code int")
    parts = pc.sketches(df, ["day", "g"], "v")
    whole = pc.percentiles(pc.merged(parts, ["g"]), ["g"], {"p50": 0.5, "p99": 0.99})
    got = {r.g: r for r in whole.collect()}
    assert set(got) == {"a", "b", None} and got[None].n == 1 and abs(got[None].p50 - 4) <= 4 / 512
    for g in ("a", "b"):
        own = np.sort([v for _, k, v in rows if k == g])
        assert got[g].n == len(own)
        assert all(ranks_off(own, got[g][name], share) <= pc.rank_error(len(own)) for name, share in (("p50", 0.5), ("p99", 0.99)))
    once = pc.sketches(df, ["g"], "v")
    assert {r.g: bytes(r.sketch) for r in once.collect()} == {r.g: bytes(r.sketch) for r in pc.merged(parts, ["g"]).collect()}
    # taking day 0 out again equals never having had it
    signed = spark.createDataFrame([(g, v, 1) for _, g, v in rows] + [(g, v, -1) for day, g, v in rows if day == 0], "g string, v double, w int")
    rest = pc.sketches(df.where("day > 0 and g is not null"), ["g"], "v").collect()
    assert {r.g: bytes(r.sketch) for r in pc.sketches(signed, ["g"], "v", "w").collect()} == {r.g: bytes(r.sketch) for r in rest}
    assert pc.sketches(df.limit(0), ["g"], "v").count() == 0 and pc.merged(parts.limit(0), ["g"]).count() == 0
    gone = pc.sketches(signed.where("false").union(spark.createDataFrame([("z", 1.0, 1), ("z", 1.0, -1)], signed.schema)), ["g"], "v", "w")
    assert [tuple(r) for r in pc.percentiles(gone, ["g"], {"p50": 0.5}).collect()] == [("z", 0, None)]


def test_groups_longer_than_a_batch(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.range(3000).selectExpr("id % 3 as g", "cast(id as double) as v", "cast(id % 50 as int) as day")
    whole = {r.g: bytes(r.sketch) for r in pc.sketches(df, ["g"], "v").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {r.g: bytes(r.sketch) for r in pc.sketches(df, ["g"], "v").collect()} == whole
        assert {r.g: bytes(r.sketch) for r in pc.merged(pc.sketches(df, ["day", "g"], "v"), ["g"]).collect()} == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_valid_runs(spark):
    t = d.datetime(2026, 1, 1, 5)
    rows = [(1, t, " Lookup", "Hybrid", 5.0), (1, t, "lookup", "hybrid", 5.0), (2, t, "out-of-scope", "vector", -1.0), (3, t, "x", "y", 9999999.0), (4, t, "x", None, 7.0), (None, t, "x", "y", 1.0), (None, t, "x", "y", 1.0), (5, t, "x", "y", float("nan")), (6, t, "x", "y", None)]
    df = spark.createDataFrame(rows, "run_id long, ts timestamp, route string, mode string, latency_ms double").withColumn("query", F.lit("q"))
    got = sorted((r.route, r.mode or "", r.latency_ms) for r in pc.valid_runs(df).collect())
    assert got == [("lookup", "hybrid", 5.0), ("x", "", 7.0), ("x", "y", 1.0), ("x", "y", 1.0)]


def brute_cost(capacity, targets, total):
    """The least cost over all whole assignments of a tiny graph."""
    names = [(s, p, t) for p in sorted(capacity) for s in p for t in range(1, targets[s][1] + 1)]
    present = sorted({s for p in capacity for s in p})
    whole = sum(targets[s][0] for s in present)
    quota = {s: int(total * targets[s][0] / whole) for s in present}
    best = None
    for flows in itertools.product(*[range(capacity[p] + 1) for _, p, _ in names]):
        used, cells = dict.fromkeys(present, 0), {}
        for (s, p, t), f in zip(names, flows, strict=True):
            used[s] += f
            cells[p, t] = cells.get((p, t), 0) + f
        if any(used[s] > quota[s] for s in present) or any(v > capacity[p] for (p, _), v in cells.items()):
            continue
        cost = sum(f * (t - 1) for (_, _, t), f in zip(names, flows, strict=True)) + mix.LACK * sum(quota[s] - used[s] for s in present)
        best = cost if best is None else min(best, cost)
    return best


def test_flow_is_of_least_cost():
    for total in (2, 4, 6):
        capacity, targets = {("a",): 2, ("a", "b"): 2, ("b",): 1}, {"a": (0.5, 1), "b": (0.5, 2)}
        flows = mix.route(capacity, targets, total)
        cost = sum(f * (t - 1) for (_, _, t), f in flows.items()) + mix.LACK * (2 * int(total * 0.5) - sum(flows.values()))
        assert cost == brute_cost(capacity, targets, total)


def test_selection_keeps_repeats_and_reaches_shares(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["big"] * 8 + ["Small-One", " small one"]), f"text number {i} " + "word " * rng.randint(5, 40)) for i in range(600)]
    docs += [(1000, None, "no source"), (1001, "big", ""), (1002, "big", None), (1003, "other", "not asked for"), (1004, "BIG", docs[0][2]), (1005, "small one", docs[0][2])]
    df = spark.createDataFrame([(*x, 3) for x in docs], "doc_id long, source string, text string, tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small_one", 0.4, 4), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    chosen = mix.selection(df, targets)
    report = {r.source: r for r in mix.mix_report(df, targets, chosen).collect()}
    assert report["absent"].used_tokens == 0 and report["absent"].actual_share == 0
    assert abs(report["big"].actual_share - 0.5 / 0.9) < 0.02 and abs(report["small_one"].actual_share - 0.4 / 0.9) < 0.02
    rows = chosen.collect()
    assert all(r.copies <= (1 if r.source == "big" else 4) for r in rows) and len({(r.doc_id, r.source) for r in rows}) == len(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix.selection(df, targets).collect()))
    # more than there is: each source gives all it may
    all_of_it = {r.source: r for r in mix.mix_report(df, targets, mix.selection(df, targets, total=10**7)).collect()}
    have = {r.source: r.most_copies for r in all_of_it.values()}
    assert have["big"] == 1 and have["small_one"] == 4
    assert mix.selection(df.limit(0), targets).count() == 0 and mix.selection(df, targets.limit(0)).count() == 0
