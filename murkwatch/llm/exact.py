"""Exact deduplication by content sort.

Normalised bytes are range-partitioned by sampled splitters and sorted within each range, on disk where memory is short,
so equal texts lie next to each other; neighbours are compared in full. The range key is a bounded prefix, the digest
and the identifier: a text that a third of all rows share is cut into several ranges at identifiers, and the parts of
such a group, at most two a range, are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .shared import id_and_text, shuffle_width

#: A single space is left alone; any other run of the six characters becomes one space.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text):
    return F.regexp_replace(text, RUNS, " ")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 48) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each input row.

    Texts are equal when they are after each run of spaces, tabs, line feeds, vertical tabs, form feeds and carriage
    returns is replaced by one space; null counts as empty. The smallest doc_id of a group stays. Of rows that share
    that doc_id and text, the first in sort order stays, the others have kept = false. A null doc_id sorts first.
    """
    rows = id_and_text(docs, id_col, text_col)
    content = normalised(F.col("text")).cast("binary")
    keyed = rows.select("doc_id", content.alias("content")).select(
        "doc_id", "content", F.sha2("content", 256).alias("digest"), F.substring("content", 1, prefix).alias("head"))
    # The tail keeps rows apart that are equal in everything, so that they too can be dealt to several ranges.
    order = ["head", "digest", "doc_id"]
    ranged = keyed.withColumn("tail", F.monotonically_increasing_id()).repartitionByRange(shuffle_width(docs), *order, "tail")
    # The same order within a range: only then is a group that a splitter cuts the last run of one range and the first of the next.
    placed = ranged.sortWithinPartitions("head", "digest", "content", "doc_id", "tail").select("doc_id", "digest", "content", "tail")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    parts = cut_lineage(placed.mapInArrow(
        _runs, f"doc_id {id_type}, keep_id {id_type}, group_size long, tail long, text_sha256 string, edge binary"))

    # An edge part is the first or last run of a range; only there can a group go on.
    split = (parts.where(F.col("edge").isNotNull()).groupBy("edge")
             .agg(F.min(F.struct(F.col("keep_id").isNotNull(), "keep_id", "tail")).alias("least"),
                  F.sum("group_size").alias("whole"), F.count("*").alias("n"), F.first("text_sha256").alias("text_sha256"))
             .where("n > 1").select("text_sha256", F.col("least.keep_id").alias("whole_keep"), F.col("least.tail").alias("whole_tail"), "whole"))
    joined = parts.join(F.broadcast(split), "text_sha256", "left")
    inside = F.col("whole").isNotNull()
    return joined.select(
        "doc_id", F.when(inside, F.col("whole_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(inside, F.col("whole")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("tail").isNotNull() & (~inside | (F.col("tail") == F.col("whole_tail")))).alias("kept"), "text_sha256")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours of one range; a run's rows wait, as identifiers, until its end is seen."""
    text: bytes | None = None
    digest, ids, tail, at_edge = "", [], 0, True
    names = ["doc_id", "keep_id", "group_size", "tail", "text_sha256", "edge"]
    kind = pa.int64()
    out: list[list] = [[] for _ in names]

    def close(edge: bool) -> None:
        n = len(ids)
        for column, values in zip(out, (ids, [ids[0]] * n, [n] * n, [tail] + [None] * (n - 1), [digest] * n,
                                        [text if edge else None] + [None] * (n - 1))):
            column.extend(values)

    def told() -> pa.RecordBatch:
        types = [kind, kind, pa.int64(), pa.int64(), pa.string(), pa.binary()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
        for column in out:
            column.clear()
        return batch

    for batch in batches:
        kind = batch.column(0).type
        for doc_id, sha, content, row in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if content != text:
                if text is not None:
                    close(at_edge)
                    at_edge = False
                    if len(out[0]) >= 4096:
                        yield told()
                text, digest, ids, tail = content, sha, [], row
            ids.append(doc_id)
    if text is not None:
        close(True)
        yield told()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without later copies, all columns as they are: one row for each distinct normalised text.

    Rows that share doc_id and text are equal to the operator; one of them stays.
    """
    key = F.struct(F.col(id_col).alias("id"))
    kept = groups(docs, id_col, text_col).where("kept").select(F.struct(F.col("doc_id").alias("id")).alias("_key"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(normalised(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)
    met = docs.withColumns({"_key": key, "_sha": sha}).join(kept, ["_key", "_sha"], "left_semi")
    return met.dropDuplicates(["_key", "_sha"]).select(*docs.columns)
