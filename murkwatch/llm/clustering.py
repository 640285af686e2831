"""Centroid clustering with heaps of bound gaps.

Vectors lie in blocks. In a block every cluster keeps a heap of its vectors, ordered by the gap between the lower bound of
the distance to any other centroid and the upper bound of the distance to its own. Centroids that move shrink all gaps of a
cluster alike, so a vector enters with its gap plus what the cluster has drifted so far, and a round only pops the
vectors whose entry the drift has caught up with. These are compared with all centroids again and enter the heap of their
cluster; the others are not looked at. Blocks report how sums and counts change, so a round sends k * (d + 1) numbers a task.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_table

#: Vectors of a block.
BLOCK = 4096
#: Components stay below it, so that squared distances fit 64 bits.
LARGEST = 1 << 26


def grid_vectors(vectors: DataFrame, dimensions: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors with exactly ``dimensions`` finite components, each as floor(scale * x)."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return vectors.where((F.size(x) == dimensions) & F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to all centroids."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)[None, :]


def _scan(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid, the smaller number at ties, and the gap to the second nearest."""
    each, rows = _distances(x, centres), np.arange(len(x))
    nearest = each.argmin(axis=1)
    best = each[rows, nearest]
    if len(centres) == 1:
        return nearest, np.full(len(x), np.inf)
    each[rows, nearest] = np.iinfo(np.int64).max
    return nearest, np.sqrt(each.min(axis=1).astype(float)) - np.sqrt(best.astype(float))


def _moved(x: np.ndarray, to: np.ndarray, k: int, sign: int, change: np.ndarray) -> None:
    """Adds vectors to the sums and counts of their clusters, or takes them away."""
    np.add.at(change[:, :-1], to, sign * x)
    change[:, -1] += sign * np.bincount(to, minlength=k)


class Block:
    """Vectors, their clusters, and a heap of (key, row) for each cluster."""

    def __init__(self, x: np.ndarray, cluster: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.x, self.cluster, self.heaps = x, cluster, heaps

    @classmethod
    def first(cls, x: np.ndarray, centres: np.ndarray) -> tuple[Block, np.ndarray]:
        cluster, gap = _scan(x, centres)
        heaps = [list(zip(gap[rows].tolist(), rows.tolist())) for rows in (np.flatnonzero(cluster == c) for c in range(len(centres)))]
        for heap in heaps:
            heapq.heapify(heap)
        change = np.zeros((len(centres), x.shape[1] + 1), dtype=np.int64)
        _moved(x, cluster, len(centres), 1, change)
        return cls(x, cluster, heaps), change

    def advance(self, centres: np.ndarray, drifted: np.ndarray) -> np.ndarray:
        """Pops what the drift of its cluster has reached, and compares it with all centroids again."""
        expired = []
        for heap, drift in zip(self.heaps, drifted):
            reached = drift * (1 + 1e-12) + 1e-5  # square roots are rounded; what is close to the border is compared as well
            while heap and heap[0][0] <= reached:
                expired.append(heapq.heappop(heap)[1])
        change = np.zeros((len(centres), self.x.shape[1] + 1), dtype=np.int64)
        if expired:
            rows = np.array(expired)
            x = self.x[rows]
            nearest, gap = _scan(x, centres)
            _moved(x, self.cluster[rows], len(centres), -1, change)
            _moved(x, nearest, len(centres), 1, change)
            self.cluster[rows] = nearest
            for row, c, key in zip(expired, nearest.tolist(), (gap + drifted[nearest]).tolist()):
                heapq.heappush(self.heaps[c], (key, row))
        return change

    def packed(self) -> tuple[bytes, int, bytes, bytes, bytes, bytes]:
        kind = np.int16 if max(int(self.x.max(initial=0)), -int(self.x.min(initial=0))) < 1 << 15 else np.int32
        flat = [entry for heap in self.heaps for entry in heap]
        return (self.x.astype(kind).tobytes(), np.dtype(kind).itemsize, self.cluster.astype(np.int32).tobytes(),
                np.array([key for key, _ in flat]).tobytes(), np.array([row for _, row in flat], dtype=np.int32).tobytes(),
                np.array([len(heap) for heap in self.heaps], dtype=np.int32).tobytes())

    @classmethod
    def unpacked(cls, vectors: bytes, width: int, cluster: bytes, keys: bytes, rows: bytes, sizes: bytes) -> Block:
        clusters = np.frombuffer(cluster, np.int32).astype(np.int64)
        x = np.frombuffer(vectors, np.int16 if width == 2 else np.int32).astype(np.int64).reshape(len(clusters), -1)
        entries = list(zip(np.frombuffer(keys).tolist(), np.frombuffer(rows, np.int32).tolist()))
        ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
        return cls(x, clusters, [entries[a:b] for a, b in zip([0, *ends], ends)])


_STATE = "vectors binary, width int, clusters binary, heap_keys binary, heap_rows binary, heap_sizes binary, change binary"
_PACKED = ["vectors", "width", "clusters", "heap_keys", "heap_rows", "heap_sizes"]


def _record(ids: pa.Array, block: Block, change: np.ndarray) -> pa.RecordBatch:
    parts = [pa.array([value], pa.int32() if isinstance(value, int) else pa.binary()) for value in (*block.packed(), change.tobytes())]
    held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([held, *parts], names=["ids", *_PACKED, "change"])


def _blocks(grid: DataFrame, centres: np.ndarray) -> DataFrame:
    """Blocks of vectors with their first clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                x = piece.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(piece.num_rows, -1)
                if x.size and (x.max() >= LARGEST or x.min() <= -LARGEST):
                    raise ValueError(f"a component reaches {LARGEST} steps of the grid; choose a smaller scale")
                yield _record(piece.column(0), *Block.first(x, centres))

    return grid.mapInArrow(run, f"ids array<{grid.schema['id'].dataType.simpleString()}>, {_STATE}")


def _advanced(state: DataFrame, centres: np.ndarray, drifted: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block.unpacked(*(batch.column(name)[k].as_py() for name in _PACKED))
                yield _record(batch.column("ids")[k].values, block, block.advance(centres, drifted))

    return state.mapInArrow(run, state.schema)


def _changes(state: DataFrame, shape: tuple[int, int]) -> list[list[int]]:
    """Sums and counts over all blocks: one row a task, then one for each of the k * (d + 1) numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape[0] * shape[1], dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["change"])

    parts = state.select("change").mapInArrow(run, "change array<long>").select(F.posexplode("change").alias("at", "x"))
    sums = dict(parts.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)"))).collect())
    return [[int(sums.get(row * shape[1] + at, 0)) for at in range(shape[1])] for row in range(shape[0])]


def _assigned(state: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, cluster, distance) for each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block.unpacked(*(batch.column(name)[k].as_py() for name in _PACKED))
                apart = block.x - centres[block.cluster]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[k].values, pa.array(block.cluster, pa.int32()), pa.array((apart * apart).sum(axis=1), pa.int64())],
                    names=["id", "cluster", "distance"])

    return state.mapInArrow(run, f"id {state.schema['ids'].dataType.elementType.simpleString()}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, dimensions: int = 64, rounds: int = 3, scale: int = 64, seed: str = "1",
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(``id_col``, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each vector that is kept.

    Kept are vectors with exactly ``dimensions`` components, none null or not finite; others and null vectors give no row.
    Components become floor(scale * x). The k kept vectors with the smallest sha256 of ``<seed>:<id>`` start as centroids
    (ties, as among repeated ids, by content; null ids come last); with fewer vectors there are fewer centroids. Each round
    assigns all vectors exactly (ties to the smaller number) and moves non-empty centroids to the floor of the mean. At the
    end vectors are assigned once more. Rows with null or repeated ids are rows of their own. An empty table gives no rows.
    A component of 2**26 steps or more is an error: squared distances would not fit 64 bits. Other columns are not read.
    """
    grid = grid_vectors(vectors, dimensions, scale, id_col, vector_col)
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    seeds = [row.v for row in grid.withColumn("_hash", named).orderBy(F.asc_nulls_last("_hash"), "v").limit(k).collect()]
    spark = vectors.sparkSession
    ends = f"{id_col} {grid.schema['id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not seeds:
        return spark.createDataFrame([], ends)
    if any(abs(c) >= LARGEST for v in seeds for c in v):
        raise ValueError(f"a component reaches {LARGEST} steps of the grid; choose a smaller scale")
    centres, k = np.array(seeds, dtype=np.int64), len(seeds)
    state = cut_lineage(_blocks(grid, centres))
    sums, drifted = [[0] * (dimensions + 1) for _ in range(k)], np.zeros(k)
    for _ in range(rounds):
        sums = [[a + b for a, b in zip(*rows)] for rows in zip(sums, _changes(state, (k, dimensions + 1)))]
        moved = np.array([[x // row[-1] for x in row[:-1]] if row[-1] else centre for row, centre in zip(sums, centres.tolist())], dtype=np.int64)
        drift = np.sqrt(((moved - centres) ** 2).sum(axis=1).astype(float))
        others = np.array([max(np.delete(drift, c), default=0.0) for c in range(k)])
        centres, drifted, before = moved, drifted + drift + others, state
        state = cut_lineage(_advanced(before, centres, drifted))
        drop_table(before)
    assigned = cut_lineage(_assigned(state, centres))
    drop_table(state)
    inertia = dict(assigned.groupBy("cluster").agg(F.sum("distance")).collect())
    names = [hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest() for centre in centres.tolist()]
    facts = spark.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), names[c]) for c in range(k)],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
