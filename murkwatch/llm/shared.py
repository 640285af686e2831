"""Helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six characters that separate words.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches, so that what a task builds at once stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def batches_of_bytes(batches: Iterator[pa.RecordBatch], most: int = 8 << 20, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows that hold about ``most`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(rows, int(most / max(batch.nbytes / batch.num_rows, 1))))
        yield from small_batches([batch], step)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names; null text becomes empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hashed_chunk(keys: list[Column | str], chunks: Column | int) -> Column:
    """Deals rows to ``chunks`` numbers by a hash of ``keys``."""
    return F.pmod(F.xxhash64(*keys), F.lit(chunks) if isinstance(chunks, int) else chunks)
