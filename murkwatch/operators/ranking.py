"""Global order without a global window.

A window without a partition key runs in one task. Here rows are first reduced to one per
distinct value, cut into ranges at approximate quantiles, and summed twice: over whole ranges
(a few rows) and inside each range (in parallel). The result is exact whatever the cut points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 128


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[f"_o_{k}"]) for k in keys))


def add_ranges(df: DataFrame, order: str, ranges: int = RANGES) -> DataFrame:
    """Append _range: position of ``order`` among approximate quantiles (one small row, broadcast)."""
    fractions = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = df.agg(F.percentile_approx(order, fractions, F.lit(1000)).alias("_cuts"))
    return df.crossJoin(F.broadcast(cuts)).withColumn(
        "_range", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")


def running_before(df: DataFrame, keys: list[str], order: str, columns: list[str], ranged: bool = False) -> DataFrame:
    """Append before_<column>: sum of ``column`` over all smaller ``order`` values of the same keys.

    ``df`` holds one row per (keys, order). ``ranged`` says that _range is already present.
    """
    base = df if ranged else add_ranges(df, order)
    part = [*keys, "_range"]
    totals = base.groupBy(*part).agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_o_{k}") for k in part],
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in columns])
    inside = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = base.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l_{c}") for c in columns])
    joined = local.join(offsets, _same(local, offsets, part))
    return joined.select(*df.columns, *[(F.col(f"_b_{c}") + F.col(f"_l_{c}")).alias(f"before_{c}") for c in columns]).drop("_range")


def quantiles(df: DataFrame, value: str, fractions: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, by order statistics over distinct values."""
    keys = keys or []
    counts = df.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ranked = running_before(counts, keys, "v", ["n"])
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    if keys:
        renamed = total.select(*[F.col(k).alias(f"_o_{k}") for k in keys], "total")
        ranked = ranked.join(renamed, _same(ranked, renamed, keys))
    else:
        ranked = ranked.crossJoin(F.broadcast(total))
    last = F.col("before_n") + F.col("n") - 1
    aggs = []
    for name, p in fractions.items():
        k = (F.col("total") - 1) * F.lit(p)
        low = F.max(F.when((F.col("before_n") <= F.floor(k)) & (F.floor(k) <= last), F.col("v")))
        high = F.max(F.when((F.col("before_n") <= F.ceil(k)) & (F.ceil(k) <= last), F.col("v")))
        share = F.max(k - F.floor(k))
        aggs.append((low + (high - low) * share).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def hash_rank(df: DataFrame, keys: list[str], draw: Column, tie: str) -> DataFrame:
    """Append rank (1-based order by a 32-bit hash, then ``tie``) and total within ``keys``.

    The hash is uniform, so its top 12 bits split every key, also one with a third of all rows,
    into 4096 even parts; ranks inside a part are shifted by the sizes of the parts before it.
    """
    base = df.withColumn("_draw", draw).withColumn("_part", F.shiftright("_draw", 20))
    part = [*keys, "_part"]
    sizes = base.groupBy(*part).agg(F.count("*").alias("_size"))
    by_key = Window.partitionBy(*keys)
    offsets = sizes.select(
        *[F.col(k).alias(f"_o_{k}") for k in part],
        F.coalesce(F.sum("_size").over(by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_size").over(by_key).alias("total"))
    local = base.withColumn("_in", F.row_number().over(Window.partitionBy(*part).orderBy("_draw", tie)))
    joined = local.join(offsets, _same(local, offsets, part))
    return joined.select(*df.columns, (F.col("_before") + F.col("_in")).alias("rank"), "total")
