"""Exact quantiles of groups of any size.

Values fall into buckets by their order; counts per bucket say which bucket holds a rank, and only that
bucket's distinct values are put in order. No task sorts a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each doubling of the value.
FINE = 64


def _bucket(v: Column) -> Column:
    size = F.floor(F.log2(F.abs(v)) * FINE) + FINE * 1100
    return F.when(v == 0, 0).when(v > 0, size).otherwise(-size).cast("long")


def values_at(values: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """``(*by, n, <name of each rank>)``: the values at the given ranks, counted from 1, of each group.

    A rank is an expression of ``n``, the group's number of values; it's held within 1 and ``n``. Nulls
    and NaN don't count; groups without values don't come out.
    """
    v = F.col(value).cast("double")
    rows = values.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("v"))
    distinct = rows.groupBy(*by, _bucket(F.col("v")).alias("bucket"), "v").agg(F.count(F.lit(1)).alias("c"))
    buckets = distinct.groupBy(*by, "bucket").agg(F.sum("c").alias("c"))
    inside = Window.partitionBy(*by).orderBy("bucket")
    buckets = buckets.withColumn("before", F.sum("c").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
    buckets = buckets.withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.least(F.col("n"), rank)).cast("long").alias("rank")) for name, rank in ranks.items()])
    chosen = buckets.select(*by, "bucket", "before", "c", "n", F.explode(wanted).alias("w")).where("w.rank > before and w.rank <= before + c")
    chosen = chosen.select(*by, "bucket", "before", "n", "w.name", "w.rank")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "bucket"]]
    near = distinct.alias("d").join(chosen.alias("r"), same).select(*[f"d.{c}" for c in by], "r.name", "r.rank", "r.n", "r.before", "d.v", "d.c")
    upto = F.sum("c").over(Window.partitionBy(*by, "name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    hit = near.withColumn("upto", F.col("before") + upto).where("rank <= upto and rank > upto - c")
    return hit.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])


def nearest_rank(values: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Percentiles as values of the data: the one at rank ``round(p / 100 * n)``, half to even, at least 1."""
    return values_at(values, by, value, {name: F.bround(F.lit(p / 100.0) * F.col("n"), 0) for name, p in points.items()})


def continuous(values: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Percentiles between values of the data, by linear interpolation."""
    at = lambda p: F.lit(p / 100.0) * (F.col("n") - 1)
    ranks = {}
    for name, p in points.items():
        ranks[f"{name}_lo"], ranks[f"{name}_hi"] = F.floor(at(p)) + 1, F.ceil(at(p)) + 1
    both = values_at(values, by, value, ranks)
    part = lambda p: at(p) - F.floor(at(p))
    return both.select(*by, "n", *[(F.col(f"{m}_lo") + (F.col(f"{m}_hi") - F.col(f"{m}_lo")) * part(p)).alias(m) for m, p in points.items()])
