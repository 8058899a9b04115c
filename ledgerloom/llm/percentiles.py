"""Percentiles of very large numeric columns, from dyadic Count-sketches.

A value becomes a code of ``UNIVERSE`` bits that keeps the order: sign, exponent and leading bits of the
mantissa, over the whole range of doubles. For each binary resolution of the codes finer than ``PLAIN``
intervals a signed sketch estimates how many values lie in each dyadic interval: ``DEPTH`` rows of ``WIDTH``
counters. The finest resolution with at most ``PLAIN`` intervals has a counter for each, and those coarser
are its sums. Sketches are linear: those of days add up, and subtracting takes values out again. They are
kept as their counters that aren't zero, so a sketch of few values is small. A rank is inverted by descending
the levels.

Error: the value found is within 1/512 of a value whose rank is within ``rank_error(n)``, ``ERROR`` times n, of
the one asked for, with a chance over 0.97. Values below 2.3e-308 in size count as 0. The proof, for one row of
one level: the chance to share a counter with one of the WIDTH / 16 most frequent other intervals is at most
1/16. Any other interval has at most 16 n / WIDTH values, so the squares of the others' counts add up to at most
16 n² / WIDTH, and the variance of the estimate to 16 n² / WIDTH². It is off by more than four deviations,
16 n / WIDTH, with a chance of at most 1/16. So a row fails with a chance of at most 1/8, and the median of
seven with 0.0062. A descent asks each of the ``SKETCHED`` levels once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank error, as a share of the number of values, that the sketches are sized for.
ERROR = 0.005
FRACTION, LOWEST = 8, -1022
UNIVERSE = 12 + FRACTION
ZERO = 2 ** (UNIVERSE - 1)
DEPTH = 7


def shape(error: float) -> tuple[int, int]:
    """Width and number of sketched levels by the proof: the fewest levels that fit their own width."""
    for levels in range(UNIVERSE):
        width = math.ceil(16 * max(1, levels) / error)
        if 2 ** (UNIVERSE - levels) <= width * DEPTH:
            return width, levels
    raise ValueError("the error must be below 1")


WIDTH, SKETCHED = shape(ERROR)
PLAIN = 2 ** (UNIVERSE - SKETCHED)
#: Counters of the finest plain level come first, then the rows of each sketched level.
CELLS = PLAIN + SKETCHED * DEPTH * WIDTH


def code(value: Column) -> Column:
    """The code of a finite value, in the JVM; greater values never have smaller codes."""
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    mantissa = F.floor((size * F.pow(F.lit(2.0), -exponent) - 1) * 2**FRACTION)
    steps = F.greatest(exponent - LOWEST, F.lit(0)) * 2**FRACTION + F.least(F.greatest(mantissa, F.lit(0)), F.lit(2**FRACTION - 1)) + 1
    steps = F.least(steps, F.lit(ZERO - 1))
    return F.when(size < 2.0**LOWEST, ZERO).when(value > 0, ZERO + steps).otherwise(ZERO - steps).cast("int")


def value_of(codes: np.ndarray) -> np.ndarray:
    """The middle of what each code stands for."""
    steps = np.asarray(codes).astype(np.int64) - ZERO
    at = np.maximum(np.abs(steps) - 1, 0)
    size = np.ldexp(1 + (at % 2**FRACTION + 0.5) / 2**FRACTION, at // 2**FRACTION + LOWEST)
    return np.where(steps == 0, 0.0, np.sign(steps) * size)


def _hashed(level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counter and sign of each interval in each row of a sketched level."""
    seeds = np.random.default_rng(1000 + level).integers(1, 2**63, (DEPTH, 2), dtype=np.uint64) | np.uint64(1)
    x = nodes.astype(np.uint64)[None, :] * seeds[:, :1] + seeds[:, 1:]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    row = PLAIN + (level * DEPTH + np.arange(DEPTH))[:, None] * WIDTH
    return row + ((x >> np.uint64(8)) % np.uint64(WIDTH)).astype(np.int64), np.where(x & np.uint64(1), 1, -1)


def _summed(group: np.ndarray, cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys ``group * CELLS + cell`` in order and their sums, without zeros."""
    keys, at = np.unique(group * CELLS + cells, return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, at, counts)
    return keys[sums != 0], sums[sums != 0]


def add(group: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of groups of codes with counts, which are negative to take values out."""
    groups, cells, values = [group], [codes >> SKETCHED], [counts]
    for level in range(SKETCHED):
        own, signs = _hashed(level, codes >> level)
        groups.append(np.tile(group, DEPTH))
        cells.append(own.ravel())
        values.append((signs * counts).ravel())
    return _summed(np.concatenate(groups), np.concatenate(cells), np.concatenate(values))


def _looked_up(keys: np.ndarray, sums: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return np.where(keys[at] == wanted, sums[at], 0) if len(keys) else np.zeros(wanted.shape, np.int64)


def quantiles(keys: np.ndarray, sums: np.ndarray, groups: int, shares: list[float]) -> np.ndarray:
    """The value at each share, by nearest rank, of each of the groups; NaN where a sketch is of nothing."""
    keys, sums = _summed(keys // CELLS, keys % CELLS, sums) if (keys[1:] == keys[:-1]).any() else (keys, sums)
    plain = keys % CELLS < PLAIN
    own, node_of, count = keys[plain] // CELLS, keys[plain] % CELLS, sums[plain]
    upto = np.concatenate(([0], np.cumsum(count)))
    first = np.searchsorted(own, np.arange(groups + 1))
    total = upto[first[1:]] - upto[first[:-1]]
    out = np.full((groups, len(shares)), np.nan)
    full = np.flatnonzero(total > 0)
    if not len(full):
        return out
    group = np.repeat(full, len(shares))
    rank = np.maximum(1.0, np.ceil(np.round(np.tile(np.array(shares), len(full)) * total[group], 9)))
    # the plain level by its running sums, the sketched ones by estimates
    at = np.searchsorted(upto, upto[first[group]] + rank, "left") - 1
    rest, whole, node = rank - (upto[at] - upto[first[group]]), count[at].astype(float), node_of[at]
    for level in range(SKETCHED - 1, -1, -1):
        cells, signs = _hashed(level, 2 * node)
        left = np.median(_looked_up(keys, sums, group * CELLS + cells) * signs, axis=0)
        left = np.clip(left, 0, whole)
        right = rest > left
        rest, whole = np.where(right, rest - left, rest), np.where(right, whole - left, left)
        node = 2 * node + right
    out[full] = value_of(node).reshape(len(full), len(shares))
    return out


def rank_error(n: int) -> float:
    """A bound on the error of a rank among ``n`` values; see the proof above."""
    return SKETCHED * 16 * n / WIDTH


def _packed(keys: np.ndarray, sums: np.ndarray, groups: int) -> pa.Array:
    """The sketch of each group: eight bytes for each counter, its place in the lower and its value in the upper half."""
    # a counter beyond the half's range stands there several times; its parts add up
    times = np.abs(sums) // _MOST + 1
    if (times > 1).any():
        keys, parts = np.repeat(keys, times), np.repeat(sums // times, times)
        parts[np.cumsum(times) - 1] += sums - sums // times * times
        sums = parts
    ends = np.searchsorted(keys, np.arange(groups + 1) * CELLS)
    words = (sums.astype(np.int64) << 32 | keys % CELLS).astype("<i8")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), groups, [None, pa.py_buffer(ends.astype("<i8") * 8), pa.py_buffer(words)]).cast(pa.binary())


_MOST = 2**30


def _unpacked(sketches: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the sketch, place and value of each counter."""
    if not len(sketches):
        return (np.empty(0, np.int64),) * 3
    sketches = sketches.cast(pa.large_binary())
    ends = np.frombuffer(sketches.buffers()[1], "<i8", len(sketches) + 1, 8 * sketches.offset) // 8
    words = np.frombuffer(sketches.buffers()[2] or b"", "<i8")[ends[0] : ends[-1]]
    return np.repeat(np.arange(len(sketches)), np.diff(ends)), words & 0xFFFFFFFF, words >> 32


def _numbered(rows: pa.Table, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's group, in order of appearance, and the first row of each group."""
    number = np.zeros(rows.num_rows, np.int64)
    for c in by:
        codes = rows.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        number = np.unique(number * (codes.max() + 2) + codes + 1, return_inverse=True)[1]
    _, first, number = np.unique(number, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[number], first[order]


def _schema(df: DataFrame, by: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "n long", "sketch binary"])


def _totals(rows: pa.Table, by: list[str]) -> pa.Table:
    """Sketches ``(*by, n, sketch)`` summed up by group."""
    number, first = _numbered(rows, by)
    if len(first) == rows.num_rows:
        return rows
    at, cells, counts = _unpacked(rows.column("sketch").combine_chunks())
    return _as_table(rows, by, number, first, rows.column("n").to_numpy(), _packed(*_summed(number[at], cells, counts), len(first)))


def _built(rows: pa.Table, by: list[str]) -> pa.Table:
    """Sketches of counted codes ``(*by, _code, _count)`` by group."""
    number, first = _numbered(rows, by)
    codes, counts = (rows.column(c).to_numpy().astype(np.int64) for c in ("_code", "_count"))
    return _as_table(rows, by, number, first, counts, _packed(*add(number, codes, counts), len(first)))


def _as_table(rows, by, number, first, n, made) -> pa.Table:
    sums = np.zeros(len(first), np.int64)
    np.add.at(sums, number, n)
    return pa.table([*(rows.column(c).take(pa.array(first)) for c in by), pa.array(sums), made], names=[*by, "n", "sketch"])


def _in_groups(rows: DataFrame, by: list[str], make: Callable, schema: str, whole: bool = True) -> DataFrame:
    """``make`` over batches; if ``whole``, all rows of a group are in one task, in order, and become one row.

    A group that goes on in the next batch is summed up to there and carried on, so a task holds one sum.
    """
    ordered = rows.repartition(*by).sortWithinPartitions(*by) if whole else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = make(pa.Table.from_batches([batch]), by)
            if not whole:
                yield from out.combine_chunks().to_batches()
                continue
            if kept is not None:
                out = _totals(pa.concat_tables([kept, out.cast(kept.schema)]), by)
            kept = out.slice(out.num_rows - 1).combine_chunks()
            yield from out.slice(0, out.num_rows - 1).combine_chunks().to_batches()
        if kept is not None:
            yield from kept.to_batches()

    return ordered.mapInArrow(run, schema)


def sketches(values: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """``(*by, n, sketch)``: a sketch for each group.

    Values that are null, NaN or infinite are left out; negative ones count. ``weight`` is a whole number,
    negative to take values out. Values are counted by code in the JVM first, so a group, however large,
    brings no more rows than there are codes to its sketch.
    """
    v = F.col(value).cast("double")
    good = values.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    n = F.sum(F.col(weight).cast("long")) if weight else F.count(F.lit(1))
    counted = good.groupBy(*by, code(v).alias("_code")).agg(n.alias("_count"))
    return _in_groups(counted, by, _built, _schema(values, by))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sketches added up by fewer columns: first where they lie, batch by batch, then each group in one pass.

    A group has as many parts as days or whatever they were made for; a pass holds one sum and one batch.
    """
    some = _in_groups(parts.select(*by, "n", "sketch"), by, _totals, _schema(parts, by), False)
    return _in_groups(some, by, _totals, _schema(parts, by))


def percentiles(parts: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """``(*by, n, <name of each share>)`` from one sketch for each group; null where a sketch is of nothing."""
    kinds = dict(parts.dtypes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cells, counts = _unpacked(batch.column(len(by) + 1))
            found = quantiles(at * CELLS + cells, counts, batch.num_rows, list(shares.values()))
            columns = [pa.array(found[:, i], pa.float64(), from_pandas=True) for i in range(len(shares))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by) + 1], *columns], names=[*by, "n", *shares])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "n long", *(f"{s} double" for s in shares)])
    return parts.select(*by, "n", "sketch").mapInArrow(read, schema)


def valid_runs(runs: DataFrame, most_ms: float = 9_999_999.0) -> DataFrame:
    """``(day, query, route, mode, latency_ms)`` of each run once, with names in one writing.

    Valid is a latency from 0 up to, but not, ``most_ms``, the filler that stands for no measurement. Of
    rows with the same ``run_id`` the earliest counts; rows without one each count.
    """
    name = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")
    rows = runs.select("run_id", F.struct("ts", name(F.col("route")).alias("route"), name(F.col("mode")).alias("mode"), "latency_ms", "query").alias("r"))
    once = rows.where("run_id is not null").groupBy("run_id").agg(F.min("r").alias("r")).unionByName(rows.where("run_id is null"))
    flat = once.select(F.to_date("r.ts").alias("day"), "r.query", "r.route", "r.mode", "r.latency_ms")
    return flat.where((F.col("latency_ms") >= 0) & (F.col("latency_ms") < most_ms) & ~F.isnan("latency_ms"))
