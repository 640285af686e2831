"""Sequence packing by cutting-stock column generation.

Documents longer than a sequence are cut into full sequences and a rest. The lengths, rounded up to a grid, form a
histogram of at most capacity/grid sizes, whatever the corpus. A linear program over patterns (how many pieces of each
size share a sequence) is solved by column generation: the dual prices go to a knapsack by dynamic programming, which
yields the next pattern. Rounded down, the patterns are assigned to pieces by their rank within their size; what rounding
leaves is packed by decreasing size. Only the histogram reaches the driver; token ids never leave the stage that made them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bpe import read_ranks
from .shared import hashed_chunk, id_and_text, small_batches
from .wordcuts import Memo, joined

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class Tokens:
    """Ids as the tokenizer file gives them.

    Texts with the string of an added token go to the tokenizer itself; any other text, in which only the merges matter,
    goes to the rank file of the same vocabulary, part by part.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.added = [token.content for token in self.whole.get_added_tokens_decoder().values()]
        ranks = {token: i for i, token in enumerate(read_ranks(ranks_path)) if token}
        self.merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memo = Memo(lambda part: self.part(" " + part), cache(self.part))

    def part(self, text: str) -> bytes:
        return np.array(self.merges.encode_ordinary(text), dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return joined(text, self.part, self.memo)


@cache
def tokens(json_path: str, ranks_path: str, pattern: str) -> Tokens:
    """One for each Python worker."""
    return Tokens(json_path, ranks_path, pattern)


def pieces(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, capacity: int = 2048, end_id: int = 1,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_id, start, length, ids, doc_tokens): each document's ids and ``end_id``, cut after every ``capacity`` ids.

    Null text counts as empty and gives the end id alone. ``ids`` are little-endian unsigned 32-bit integers. ``row_id``
    tells rows with equal or null doc_id apart.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("row_id", F.monotonically_increasing_id())
    id_type = rows.schema["doc_id"].dataType.simpleString()
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tokens(json_path, ranks_path, pattern)
        for batch in small_batches(batches):
            at, starts, cut, totals = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = made.ids(text) + tail
                for start in range(0, len(ids), 4 * capacity):
                    at.append(i)
                    starts.append(start // 4)
                    cut.append(ids[start:start + 4 * capacity])
                    totals.append(len(ids) // 4)
            where = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(where), batch.column(2).take(where), pa.array(starts, pa.int64()),
                 pa.array([len(ids) // 4 for ids in cut], pa.int64()), pa.array(cut, pa.binary()), pa.array(totals, pa.int64())],
                names=["doc_id", "row_id", "start", "length", "ids", "doc_tokens"])

    return rows.mapInArrow(run, f"doc_id {id_type}, row_id long, start long, length long, ids binary, doc_tokens long")


def best_pattern(prices: np.ndarray) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: sizes 1..n at ``prices`` into room n; the worth and how many of each size."""
    n = len(prices)
    worth, taken = np.zeros(n + 1), np.zeros(n + 1, dtype=np.int64)
    for room in range(1, n + 1):
        each = worth[room - 1::-1][:room] + prices[:room]
        size = int(each.argmax())
        worth[room], taken[room] = (each[size], size + 1) if each[size] > worth[room - 1] + 1e-12 else (worth[room - 1], 0)
    pattern, room = np.zeros(n, dtype=np.int64), n
    while room > 0:
        if taken[room]:
            pattern[taken[room] - 1] += 1
            room -= taken[room]
        else:
            room -= 1
    return float(worth[n]), pattern


def solve(demand: np.ndarray, rounds: int = 20_000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, covering ``demand`` (pieces of size 1..n, room n) exactly."""
    n, sizes = len(demand), np.flatnonzero(demand)
    plan: list[tuple[np.ndarray, int]] = []
    left = demand.astype(np.int64).copy()
    if len(sizes):
        fill = n // (sizes + 1)
        basis = [np.eye(n, dtype=np.int64)[size] * count for size, count in zip(sizes, fill)]
        inverse, used = np.diag(1.0 / fill), demand[sizes] / fill
        for _ in range(rounds):
            prices = np.full(n, -1.0)
            prices[sizes] = inverse.sum(axis=0)
            worth, pattern = best_pattern(prices)
            if worth <= 1 + 1e-7:
                break
            enters = inverse @ pattern[sizes]
            usable = enters > 1e-9
            ratio = np.where(usable, used / np.where(usable, enters, 1), np.inf)
            out = int(ratio.argmin())
            step = ratio[out]
            used = np.maximum(used - step * enters, 0)
            used[out] = step
            row = inverse[out] / enters[out]
            inverse = inverse - np.outer(enters, row)
            inverse[out] = row
            basis[out] = pattern
        for pattern, times in zip(basis, used):
            fits = int(min(np.floor(times + 1e-6), *(left[k] // pattern[k] for k in np.flatnonzero(pattern))))
            if fits > 0:
                plan.append((pattern, fits))
                left -= fits * pattern
    while left.any():  # at most a few sequences for each pattern that was rounded
        room, pattern = n, np.zeros(n, dtype=np.int64)
        for size in np.flatnonzero(left)[::-1] + 1:
            count = min(room // size, int(left[size - 1]))
            pattern[size - 1], room = count, room - count * size
        held = np.flatnonzero(pattern)
        times = int(min(left[held] // pattern[held]))
        plan.append((pattern, times))
        left -= times * pattern
    return plan


def placements(plan: list[tuple[np.ndarray, int]], n: int) -> tuple[np.ndarray, ...]:
    """The plan as intervals over (size, rank): first key, first sequence, pieces a sequence holds, first slot.

    The key of a piece is the number of pieces of smaller sizes plus its rank, from 0, within its size.
    """
    rows, base = [], 0
    for pattern, times in plan:
        slot = 0
        for k in np.flatnonzero(pattern)[::-1]:
            rows.append((k, base, pattern[k], slot, times * pattern[k]))
            slot += int(pattern[k])
        base += times
    rows.sort(key=lambda row: row[:2])
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    starts = np.concatenate([[0], np.cumsum(table[:, 4])[:-1]]) if len(table) else np.zeros(0, np.int64)
    return starts.astype(np.int64), table[:, 1].copy(), table[:, 2].copy(), table[:, 3].copy()


def assign(cut: DataFrame, capacity: int = 2048, grid: int = 8, slots: int = 8192) -> DataFrame:
    """Adds sequence_id and offset to pieces with the columns row_id, start and length (1 to ``capacity``).

    Sequence ids run from 0 without gaps; within one, pieces lie without gaps from offset 0. ``cut`` should be a stored
    table: it is read for the histogram and again for the ranks. Ranks are counted within hashed chunks of a size, so
    that a size which a third of all pieces share is no single task. Equal rows may swap places, nothing else.
    """
    n = -(-capacity // grid)
    sized = cut.withColumn("_size", F.ceil(F.col("length") / grid).cast("long"))
    histogram = {row["_size"]: row["n"] for row in sized.groupBy("_size").agg(F.count("*").alias("n")).collect()}
    demand = np.zeros(n, dtype=np.int64)
    for size, count in histogram.items():
        demand[size - 1] = count
    arrays = cut.sparkSession.sparkContext.broadcast(placements(solve(demand), n))

    slots = max(slots, int(demand.sum()) // 1_000_000)
    chunks = [max(1, -(-int(d) * slots // max(1, int(demand.sum())))) for d in demand]
    before = np.concatenate([[0], np.cumsum(demand)[:-1]]).tolist()
    size_at = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("_size").cast("int"))
    dealt = sized.withColumn("_chunk", hashed_chunk(["row_id", "start"], size_at(chunks)))
    counts = dealt.groupBy("_size", "_chunk").agg(F.count("*").alias("_n"))
    so_far = F.sum("_n").over(Window.partitionBy("_size").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("_size", "_chunk", (F.coalesce(so_far, F.lit(0)) + size_at(before)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("_size", "_chunk").orderBy("row_id", "start")) - 1
    keyed = dealt.withColumn("_rank", rank).join(firsts, ["_size", "_chunk"]).withColumn("_key", F.col("_first") + F.col("_rank"))

    names = [*cut.columns, "sequence_id", "_slot"]
    held = keyed.select(*cut.columns, "_key")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, base, share, first = arrays.value
        for batch in batches:
            key = batch.column(batch.num_columns - 1).to_numpy()
            at = np.searchsorted(starts, key, side="right") - 1
            along = key - starts[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(base[at] + along // share[at]), pa.array(first[at] + along % share[at])], names=names)

    schema = cut.withColumns({"sequence_id": F.lit(0).cast("long"), "_slot": F.lit(0).cast("long")}).schema
    placed = held.mapInArrow(place, schema)
    order = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0))).drop("_slot")


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, capacity: int = 2048, end_id: int = 1,
         digest: dict | None = None, **columns: str) -> DataFrame:
    """Pieces with their sequence and offset.

    ``digest`` maps column names to expressions over a piece's columns and replaces ``ids`` where only they are wanted;
    without it the ids are kept, and ``sequences`` joins them.
    """
    cut = pieces(docs, json_path, ranks_path, pattern, capacity, end_id, **columns)
    if digest is not None:
        cut = cut.withColumns(digest).drop("ids")
    return assign(cut_lineage(cut), capacity)


def sequences(packed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens): ids of each sequence, padded to ``capacity`` unless their number is a power of two."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b""), lambda held, part: F.concat(held, part["ids"]))
    out = packed.groupBy("sequence_id").agg(ids.alias("ids"), F.sum("length").alias("n_tokens"))
    pad = F.lit(np.array([pad_id] * capacity, dtype="<u4").tobytes())
    whole = F.bit_count("n_tokens") == 1
    return out.withColumn("ids", F.when(whole, F.col("ids")).otherwise(
        F.concat("ids", F.substring(pad, F.lit(1), F.lit(4) * (F.lit(capacity) - F.col("n_tokens")).cast("int")))))
