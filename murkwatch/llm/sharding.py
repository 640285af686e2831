"""Two-pass external shuffle into shards.

The first pass scatters rows over buckets that fit a worker's memory, by a seeded hash of each row. The second pass puts a
bucket into a fixed order, shuffles it after Fisher and Yates and lays it behind the buckets before it. Both passes
together are one uniform permutation; shards are equal cuts of it, so their row counts differ by one at most. Where a
bucket begins is known before texts move, from a count of the same hashes, so texts are exchanged once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shuffle_width

#: A bucket holds about so many bytes of text, or so many rows.
BUCKET_BYTES, BUCKET_ROWS = 16 << 20, 100_000
#: Buckets whose starts are summed in one group.
_GROUP = 1024


def fisher_yates(n: int, draw: np.random.Generator) -> list[int]:
    """A uniform permutation of 0 to n - 1."""
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), draw.integers(0, np.arange(n, 1, -1)).tolist()):
        order[i], order[j] = order[j], order[i]
    return order


def _scattered(docs: DataFrame, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(row, size, _at, _hash): rows with a seeded hash of identifier and place."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1
    placed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), size.alias("size"),
                         F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_at"))
    return placed.select("row", "size", "_at", F.xxhash64(F.lit(seed), "_id", "_at").alias("_hash"))


def _bucket(buckets: int) -> Column:
    return F.pmod("_hash", F.lit(buckets)).alias("bucket")


def _starts(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, start, rows): rows of all earlier buckets, summed in two levels."""
    counts = rows.groupBy(_bucket(buckets)).agg(F.count("*").alias("rows")).withColumn("_group", F.floor(F.col("bucket") / _GROUP))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("_group").agg(F.sum("rows").alias("_all"))
    offsets = groups.select("_group", F.coalesce(F.sum("_all").over(before.orderBy("_group")), F.lit(0)).alias("_offset"))
    inside = F.coalesce(F.sum("rows").over(before.partitionBy("_group").orderBy("bucket")), F.lit(0))
    return counts.select("bucket", "rows", "_group", inside.alias("_inside")).join(offsets, "_group").select(
        "bucket", (F.col("_inside") + F.col("_offset")).alias("start"), "rows")


def shuffled(docs: DataFrame, shards: int = 16, seed: int = 20, id_col: str = "doc_id", text_col: str = "text",
             bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(row, size, shard, slot): each row of ``docs`` as a struct, with its place in the shuffled order.

    size is the text's UTF-8 length plus 1 (null text: 1). Shards are 0 to ``shards`` - 1 and their row counts differ by one at
    most; slots are gapless from 0. Every order is equally likely; it repeats for the same seed, number of shuffle
    partitions and stored table. Nulls, equal texts and repeated rows are rows of their own and are scattered like others: the
    hash takes the place of a row besides its identifier, so no group of equal rows fills a bucket. An empty table gives no
    rows. Columns of any name go along inside ``row``. ``docs`` must be a stored table: rows are numbered in reading
    order twice, and an error is raised if a bucket comes out with another count. Where bucket bytes are exceeded by one
    text alone, its bucket is larger.
    """
    rows = _scattered(docs, seed, id_col, text_col)
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    buckets = max(-(-total.bytes // bucket_bytes), -(-total.n // BUCKET_ROWS), 16 * shuffle_width(docs))
    n = total.n
    kind = docs.schema.simpleString()

    def placed(bucket: int, start: int, rows: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        if table.num_rows != rows:
            raise RuntimeError("the documents came in another order when read again; give a stored table")
        at = start + np.arange(rows)
        shard = at * shards // n
        mixed = table.take(pa.array(fisher_yates(rows, np.random.default_rng([seed, bucket]))))
        out = pa.table({"row": mixed.column("row"), "size": mixed.column("size"), "shard": pa.array(shard, pa.int32()),
                        "slot": pa.array(at - -(-shard * n // shards), pa.int64())})
        return out.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            heads = np.flatnonzero(np.asarray(batch.column("start").is_valid()))
            cuts = [*heads.tolist(), batch.num_rows]
            if cuts[0]:
                held.append(batch.slice(0, cuts[0]).select(["row", "size"]))
            for head, end in zip(cuts, cuts[1:]):
                if current is not None:
                    yield placed(*current, held)
                current = [batch.column(c)[head].as_py() for c in ("bucket", "start", "rows")]
                held = [batch.slice(head + 1, end - head - 1).select(["row", "size"])]
        if current is not None:
            yield placed(*current, held)

    # The line that tells where a bucket starts comes before its rows.
    none = F.lit(None).cast("long")
    heads = _starts(rows, buckets).select(F.lit(None).cast(kind).alias("row"), none.alias("size"), none.alias("_at"), none.alias("_hash"), "bucket", "start", "rows")
    dealt = rows.select("row", "size", "_at", "_hash", _bucket(buckets), none.alias("start"), none.alias("rows")).unionByName(heads)
    sorted_ = dealt.repartition(shuffle_width(docs), "bucket").sortWithinPartitions("bucket", F.asc_nulls_last("start"), "_hash", "_at")
    return sorted_.select("row", "size", "bucket", "start", "rows").mapInArrow(run, f"row {kind}, size long, shard int, slot long")


def write_shards(placed: DataFrame, path: str) -> None:
    """Writes each shard to a folder ``shard=<number>``, its files in the order of slots, with the columns of the documents.

    The documents must not have a column named shard or slot.
    """
    ordered = placed.repartitionByRange(shuffle_width(placed), "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select("row.*", "shard", "slot").write.partitionBy("shard").parquet(path)
