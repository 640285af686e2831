"""Isotonic calibration by ranges: adjacent violators are pooled in parallel, and no task or driver holds all blocks.

Any two neighbouring blocks whose means fall belong to one block of the solution, in whatever order they are pooled. So each
range of probabilities pools for itself, ranges are cut elsewhere in the next round, and rounds end when no border
between two ranges is violated.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_table
from .ranking import add_ranges

#: Blocks of a range at least.
RANGE = 4096
_BLOCK = "low double, high double, n long, positives long"


def _pooled(blocks: DataFrame) -> DataFrame:
    """The partitions of ``blocks``, each pooled for itself, with the partition's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for low, high, n, positives in zip(*(column.to_pylist() for column in batch.columns)):
                while held and held[-1][3] * n >= positives * held[-1][2]:  # the mean doesn't rise
                    low, _, more, ones = held.pop()
                    n, positives = n + more, positives + ones
                held.append((low, high, n, positives))
        part = TaskContext.get().partitionId()
        columns = list(zip(*held)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(values, kind) for values, kind in zip(columns, (pa.float64(), pa.float64(), pa.int64(), pa.int64()))),
             pa.array([part] * len(held), pa.int32())], names=["low", "high", "n", "positives", "part"])

    return blocks.select("low", "high", "n", "positives").mapInArrow(run, f"{_BLOCK}, part int")


def isotonic_blocks(df: DataFrame, p: str = "p", label: str = "label") -> DataFrame:
    """(low, high, n, positives): the blocks of the isotonic fit of 0/1 ``label`` on ``p``; a block's value is positives / n.

    Rows without ``p`` or ``label`` are left out; no rows, no blocks.
    """
    rows = df.where(F.col(p).isNotNull() & F.col(label).isNotNull()).select(F.col(p).cast("double").alias("low"), F.col(label).cast("long").alias("y"))
    blocks = cut_lineage(rows.groupBy("low").agg(F.count("*").alias("n"), F.sum("y").alias("positives")).withColumn("high", F.col("low")))
    width, round_, count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 0, blocks.count()
    while True:
        # Few blocks are one range; for many the number of ranges changes from round to round, and so do their borders.
        parts = min(width, -(-count // RANGE)) + round_ % 7 if count > RANGE else 1
        ranges = blocks.repartitionByRange(parts, "low").sortWithinPartitions("low")
        pooled, before = cut_lineage(_pooled(ranges)), blocks
        drop_table(before)
        # One row a range: its last block against the first one of the next range that has any.
        whole = F.struct("low", "n", "positives")
        edges = cut_lineage(pooled.groupBy("part").agg(F.count("*").alias("blocks"), F.min(whole).alias("first"), F.max(whole).alias("last")))
        after = F.lead("first").over(Window.orderBy("part"))
        falls = F.col("last.positives") * F.col("after.n") >= F.col("after.positives") * F.col("last.n")
        if not edges.withColumn("after", after).where(falls).count():
            return pooled.drop("part")
        blocks, round_, count = pooled.drop("part"), round_ + 1, edges.agg(F.sum("blocks")).first()[0]


def isotonic_value(x: Column, before: Column, after: Column) -> Column:
    """Value at ``x`` between two blocks (low, high, v): constant within a block and beyond the ends, linear in between."""
    slope = (x - before["high"]) / (after["low"] - before["high"])
    return (F.when(before.isNull(), after["v"]).when((x <= before["high"]) | after.isNull(), before["v"])
            .otherwise(before["v"] + (after["v"] - before["v"]) * slope))


def isotonic_apply(df: DataFrame, blocks: DataFrame, p: str = "p", out: str = "calibrated") -> DataFrame:
    """``df`` with ``out``: the isotonic value at ``p``; null where ``p`` is null or there are no blocks.

    Blocks and distinct probabilities lie in the same ranges. Within a range windows find the blocks around each one, and a
    range's outermost blocks are handed to its neighbours, one row a range.
    """
    block = F.struct("low", "high", (F.col("positives") / F.col("n")).alias("v"))
    none = F.lit(None).cast("struct<low: double, high: double, v: double>")
    marks = blocks.select(F.col("low").alias("x"), F.lit(0).alias("kind"), block.alias("block")).union(
        df.where(F.col(p).isNotNull()).select(F.col(p).cast("double").alias("x")).distinct().select("x", F.lit(1), none))
    ranged = add_ranges(marks, "x")
    order = Window.partitionBy("_range").orderBy("x", "kind")
    inner = ranged.withColumns({
        "_before": F.last("block", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_after": F.first("block", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))})
    ends = ranged.groupBy("_range").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    across = Window.orderBy("_range")  # one row a range
    ends = ends.select("_range", F.last("last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
                       F.first("first", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    met = inner.where("kind = 1").join(F.broadcast(ends), "_range")
    value = isotonic_value(F.col("x"), F.coalesce("_before", "_earlier"), F.coalesce("_after", "_later"))
    found = met.select(F.col("x").alias("_x"), value.alias(out))
    return df.join(found, F.col(p).cast("double") == F.col("_x"), "left").drop("_x")
