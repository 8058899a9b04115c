"""Mixing sources to target weights, by a minimum-cost flow over membership patterns.

Texts are the units: equal texts count once, and the set of target sources that hold a text is its
pattern. Token capacity of the patterns, in tiers of use (first use, second, ...), is routed to the
quotas of the sources; a later use costs more, so nothing is repeated while fresh text is left. The graph
has one node for each pattern and tier, however large the corpus. Texts are then drawn by a seeded hash.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.text import token_count
from ledgerloom.session import durable, spread

#: Parts of a pattern, at least, within which texts are put in order, and texts of a part, about, where there are more.
PARTS, PART_TEXTS = 1024, 100_000
#: Cost of a token that a source lacks; more than any repetition.
LACK = 10_000


def source_name(column: Column) -> Column:
    """Sources written in one way: lower case, words joined by underscores; blank ones are null."""
    name = F.regexp_replace(F.lower(F.trim(column)), r"[\s_-]+", "_")
    return F.when(name != "", name)


def min_cost_flow(edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge ``(from, to, capacity, cost)`` of a maximum flow of the least cost."""
    graph: dict[int, list[int]] = {}
    to, room, cost = [], [], []
    for a, b, c, w in edges:
        graph.setdefault(a, []).append(len(to))
        to.append(b), room.append(c), cost.append(w)
        graph.setdefault(b, []).append(len(to))
        to.append(a), room.append(0), cost.append(-w)
    while True:
        best, via, waiting, queued = {source: 0}, {}, deque([source]), {source}
        while waiting:
            a = waiting.popleft()
            queued.discard(a)
            for e in graph.get(a, ()):
                if room[e] > 0 and best[a] + cost[e] < best.get(to[e], 1 << 60):
                    best[to[e]], via[to[e]] = best[a] + cost[e], e
                    if to[e] not in queued:
                        queued.add(to[e])
                        waiting.append(to[e])
        if sink not in via:
            return [room[2 * i + 1] for i in range(len(edges))]
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = to[via[at] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount


def largest_total(capacity: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]]) -> int:
    """The largest total, to a thousandth, at which every source that has text reaches its share."""
    present = {s for p, c in capacity.items() for s in p if c > 0 and targets.get(s, (0, 0))[0] > 0 and targets[s][1] > 0}
    if not present:
        return 0
    whole = sum(targets[s][0] for s in present)
    alone = {s: targets[s][1] * sum(c for p, c in capacity.items() if s in p) for s in present}
    high = min(int(alone[s] / (targets[s][0] / whole)) for s in present)
    low = 0
    for _ in range(40):
        if high - low <= max(1, high // 1000):
            break
        middle = (low + high) // 2
        flows = route(capacity, targets, middle)
        lacking = middle - sum(flows.values())
        low, high = (middle, high) if lacking <= len(targets) else (low, middle)
    return low


def route(capacity: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int) -> dict[tuple[str, tuple[str, ...], int], int]:
    """Tokens by source, pattern and tier of use. A tier of a pattern serves each text once."""
    present = sorted({s for p in capacity for s in p if s in targets and targets[s][0] > 0})
    whole = sum(targets[s][0] for s in present) or 1.0
    number = {s: 1 + i for i, s in enumerate(present)}
    edges, names = [], []
    tiers: dict[tuple, int] = {}
    sink = 1_000_000_000
    for s in present:
        quota = int(total * targets[s][0] / whole)
        edges.append((0, number[s], quota, 0))
        names.append(None)
        edges.append((number[s], sink, quota, LACK))
        names.append(None)
    for p in sorted(capacity):
        for tier in range(1, max((targets[s][1] for s in p if s in number), default=0) + 1):
            node = tiers.setdefault((p, tier), 1 + len(present) + len(tiers))
            edges.append((node, sink, capacity[p], 0))
            names.append(None)
            for s in p:
                if s in number and tier <= targets[s][1]:
                    edges.append((number[s], node, capacity[p], tier - 1))
                    names.append((s, p, tier))
    flows = min_cost_flow(edges, 0, sink)
    return {n: f for n, f in zip(names, flows, strict=True) if n and f}


def units(documents: DataFrame, targets: DataFrame, tokens: Callable[[Column], Column] = token_count) -> DataFrame:
    """``(unit, doc_id, pattern, tokens, order)`` of each distinct text of a target source with a token.

    ``doc_id`` is the smallest of the text's documents. Null and empty texts and documents of other or no
    sources aren't used.
    """
    named = targets.select(source_name(F.col("source")).alias("source")).where("source is not null").distinct()
    rows = spread(documents.select("doc_id", source_name(F.col("source")).alias("source"), "text")).where("text is not null and text <> ''")
    rows = rows.select("doc_id", "source", F.unhex(F.sha2("text", 256)).alias("unit"), tokens(F.col("text")).cast("long").alias("tokens"))
    # no more sources than targets, so the sets are small
    mine = rows.join(named, "source").groupBy("unit", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    grouped = mine.groupBy("unit").agg(F.min("doc_id").alias("doc_id"), F.sort_array(F.collect_set("source")).alias("pattern"), F.max("tokens").alias("tokens"))
    # after the aggregation, so that the condition isn't moved to where it would count tokens twice
    return grouped.where("tokens > 0")


def selection(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, tokens: Callable[[Column], Column] = token_count) -> DataFrame:
    """``(doc_id, source, tokens, copies)``: what the mix takes for each source.

    ``total`` is in tokens; by default the largest at which every source with text reaches its share within
    its repeats. A source that can't fill its quota gives all it may. Shares of sources without text are
    left to the others in proportion. A source that several targets name has the sum of their shares and the
    least of their repeats; null shares and repeats count as 0.
    """
    texts = durable(units(documents, targets, tokens))
    # targets are a stated list; patterns are at most as many as sets of targets
    wanted: dict[str, tuple[float, int]] = {}
    for r in targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").where("s is not null").collect():
        share, repeats = wanted.get(r.s, (0.0, 1 << 30))
        wanted[r.s] = share + max(0.0, r.target_share or 0.0), min(repeats, max(0, r.max_repeats or 0))
    patterns = texts.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()
    capacity = {tuple(r.pattern): r.tokens for r in patterns}
    parts = max([PARTS, *(-(-r.n // PART_TEXTS) for r in patterns)])
    if total is None:
        total = largest_total(capacity, wanted)
    spans, at = [], {}
    for (source, pattern, tier), flow in sorted(route(capacity, wanted, total).items()):
        low = at.get((pattern, tier), 0)
        spans.append((list(pattern), tier, source, low, low + flow))
        at[pattern, tier] = low + flow
    spark = documents.sparkSession
    plan = spark.createDataFrame(spans, "pattern array<string>, tier int, source string, low long, high long")

    # a running sum over each pattern in seeded order: parts first, then within each part
    drawn = texts.withColumn("draw", F.xxhash64("unit", F.lit(seed))).withColumn("part", F.pmod("draw", F.lit(parts)))
    sums = drawn.groupBy("pattern", "part").agg(F.sum("tokens").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("pattern").orderBy("part")) - F.col("sum")
    sums = sums.select("pattern", "part", before.alias("before"))
    order = Window.partitionBy("pattern", "part").orderBy("draw", "unit")
    own = drawn.withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = own.join(sums, ["pattern", "part"]).withColumn("at", F.col("before") + F.col("upto") - F.col("tokens") / 2)
    # a text falls to the source in whose span its middle lies; spans are few, one for each edge of the graph
    taken = placed.join(F.broadcast(plan), "pattern").where("at >= low and at < high")
    return taken.groupBy("unit", "doc_id", "source", "tokens").agg(F.count(F.lit(1)).cast("int").alias("copies")).drop("unit")


def mix_report(documents: DataFrame, targets: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per target source: the share asked for, tokens taken, the share reached, texts and repeats."""
    asked = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    asked = asked.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    got = chosen.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"),
        F.sum("tokens").alias("distinct_tokens"),
        F.count(F.lit(1)).alias("texts"),
        F.max("copies").alias("most_copies"),
    )
    whole = F.sum("used_tokens").over(Window.partitionBy())  # one row for each target
    out = asked.join(got, "source", "left").fillna(0, ["used_tokens", "distinct_tokens", "texts", "most_copies"])
    return out.withColumn("actual_share", F.coalesce(F.col("used_tokens") / whole, F.lit(0.0)))
