"""Which names occur elsewhere, at five bytes a name.

Documents form batches by row number. A batch sends each distinct name it holds once, packed by bucket; the bucket answers
with one bit for each: whether another batch has the name too. Only what is shared needs more than that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import small_batches

#: Row numbers of a batch differ in the last bits only.
BATCH_BITS = 8
#: Names are 40 bits within a bucket.
LOW_BITS = np.uint64((1 << 40) - 1)


def exchanged(name: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names of a batch in the order (bucket, low bits); their buckets, where each came from, how often."""
    bucket = (name >> np.uint64(40)) % np.uint64(buckets)
    key = (bucket << np.uint64(40)) | (name & LOW_BITS)
    distinct, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    return distinct & LOW_BITS, (distinct >> np.uint64(40)).astype(np.int64), inverse, count


def five_bytes(names: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.asarray(names, dtype="<u8")).view(np.uint8).reshape(-1, 8)[:, :5]


def from_five_bytes(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.view("<u8").ravel()


def told(rows: DataFrame, names: Callable[[list], np.ndarray], buckets: int) -> DataFrame:
    """(batch, bucket, names) from rows (row_id, text): five bytes for each distinct name of a batch."""

    def send(batch: int, texts: list) -> pa.RecordBatch:
        low, bucket, _, _ = exchanged(names(texts), buckets)
        each, cut = five_bytes(low), np.searchsorted(bucket, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cut))
        return pa.RecordBatch.from_arrays(
            [pa.array([batch] * len(full), pa.int64()), pa.array(full, pa.int32()),
             pa.array([each[cut[k]:cut[k + 1]].tobytes() for k in full], pa.binary())], names=["batch", "bucket", "names"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, texts = None, []
        for piece in small_batches(batches):
            for row, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                if row >> BATCH_BITS != current:
                    if texts:
                        yield send(current, texts)
                    current, texts = row >> BATCH_BITS, []
                texts.append(text)
        if texts:
            yield send(current, texts)

    return rows.mapInArrow(run, "batch long, bucket int, names binary")


def answered(sent: DataFrame, buckets: int) -> DataFrame:
    """(batch, bucket, shared): for each name, in order, whether another batch has it too; one bit each."""

    def close(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        names = from_five_bytes(np.frombuffer(b"".join(row[2] for row in rows), np.uint8))
        order = np.argsort(names)
        ranked = names[order]
        same = np.zeros(len(names), dtype=bool)
        same[1:] = ranked[1:] == ranked[:-1]
        same[:-1] |= same[1:]
        shared = np.empty(len(names), dtype=bool)
        shared[order] = same
        ends = np.cumsum([len(row[2]) // 5 for row in rows])
        bits = [np.packbits(part).tobytes() for part in np.split(shared, ends[:-1])]
        return pa.RecordBatch.from_arrays(
            [pa.array([row[0] for row in rows], pa.int64()), pa.array([row[1] for row in rows], pa.int32()), pa.array(bits, pa.binary())],
            names=["batch", "bucket", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        for piece in batches:
            for row in zip(*(column.to_pylist() for column in piece.columns)):
                if held and held[-1][1] != row[1]:
                    yield close(held)
                    held = []
                held.append(row)
        if held:
            yield close(held)

    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "batch long, bucket int, shared binary")


def shared_names(bucket: np.ndarray, count: np.ndarray, answers: pa.Table, buckets: int) -> np.ndarray:
    """For each distinct name of a batch, in the order of ``exchanged``: whether it occurs again, here or elsewhere."""
    shared = count > 1
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    for k, bits in zip(answers.column("bucket").to_pylist(), answers.column("shared").to_pylist()):
        n = int(cut[k + 1] - cut[k])
        if len(bits) != -(-n // 8):
            raise RuntimeError("the documents came in another order when read again; give a stored table")
        shared[cut[k]:cut[k + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    return shared
