"""Byte-level BPE by two-tier lookup.

A text is split by the vocabulary's pattern. A pre-token that is itself a token is found by a minimal perfect hash over
the vocabulary (one probe, one comparison). A pre-token that isn't is merged: its bytes form a linked list, and a heap of
neighbouring pairs by rank yields the next merge. Both run inside narrow Arrow stages; nothing is shuffled.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .wordcuts import Memo, joined, latin


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in the order of their ids."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """Minimal perfect hash by displacement: n keys, n slots.

    Keys fall into n/2 buckets; the largest buckets choose first a seed under which all their keys meet free slots.
    A bucket of one key takes a free slot outright, stored as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.seeds = np.zeros(max(1, n // 2), dtype=np.int32)
        self.ids = np.zeros(n, dtype=np.int32)
        buckets: dict[int, list[int]] = {}
        for i, key in enumerate(keys):
            buckets.setdefault(xxhash.xxh3_64_intdigest(key) % len(self.seeds), []).append(i)
        taken = bytearray(n)
        free = iter(range(n))
        for bucket, members in sorted(buckets.items(), key=lambda item: -len(item[1])):
            if len(members) == 1:
                slots = [next(slot for slot in free if not taken[slot])]
                seed = -slots[0] - 1
            else:
                seed = 0
                while True:
                    seed += 1
                    slots = [xxhash.xxh3_64_intdigest(keys[i], seed) % n for i in members]
                    if len(set(slots)) == len(slots) and not any(taken[slot] for slot in slots):
                        break
            self.seeds[bucket] = seed
            for i, slot in zip(members, slots):
                taken[slot] = 1
                self.ids[slot] = i

    def tables(self) -> tuple[list[int], list[int]]:
        return self.seeds.tolist(), self.ids.tolist()


def _ranges(chars: set[str]) -> str:
    """The characters as the inside of a character class."""
    codes, out = sorted(map(ord, chars)), []
    for code in codes:
        if out and out[-1][1] + 1 == code:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@cache
def known_classes() -> tuple[dict[str, str], str]:
    """Letters, numbers and white space as tiktoken's pattern engine knows them, and the characters that ``regex`` reads otherwise.

    The two follow different versions of Unicode. An encoding of single bytes keeps what its pattern matches and drops the
    rest, so it tells a class when it is asked for all characters.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes, disputed = {}, set()
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        told = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        known = set(bytes(told.encode_ordinary(every)).decode())
        classes[name] = _ranges(known)
        disputed |= known ^ set(regex.findall(name, every))
    return classes, _ranges(disputed)


def _with_classes(pattern: str, classes: dict[str, str]) -> str:
    """``pattern`` with the classes written out, inside brackets and outside."""
    out, inside = [], False
    for part in regex.findall(r"\\p\{\w\}|\\.|.", pattern, flags=regex.DOTALL):
        inside = part == "[" or inside and part != "]"
        held = classes.get(part.lower() if part == r"\S" else part)
        if held and part == r"\S" and inside:
            raise ValueError("a negated class inside brackets is not supported")
        out.append(part if held is None else held if inside else f"[{'^' if part == chr(92) + 'S' else ''}{held}]")
    return "".join(out)


class Codec:
    """Encoder and decoder over one vocabulary; built on the driver, used in tasks."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern, (self.classes, self.disputes) = tokens, pattern, known_classes()
        self.present = [i for i, token in enumerate(tokens) if token]
        self.hash = PerfectHash([tokens[i] for i in self.present])
        self.prepare()

    def __getstate__(self):
        return self.tokens, self.pattern, self.classes, self.disputes, self.present, self.hash

    def __setstate__(self, state):
        self.tokens, self.pattern, self.classes, self.disputes, self.present, self.hash = state
        self.prepare()

    def prepare(self) -> None:
        self.memo = Memo(self.spaced, cache(self.ids_of))
        self.split = regex.compile(self.pattern).findall
        self.disputed = regex.compile(f"[{self.disputes}]").search if self.disputes else lambda text: None
        self.exact_split = regex.compile(_with_classes(self.pattern, self.classes)).findall
        self.seeds, slots = self.hash.tables()
        self.slot_ids = [self.present[i] for i in slots]
        # The merge step asks for pairs that mostly aren't tokens; it reads ranks from the vocabulary's own mapping.
        self.ranks = {self.tokens[i]: i for i in self.present}

    def whole(self, piece: bytes) -> int:
        """The id of a piece that is a token, else -1."""
        seed = self.seeds[xxhash.xxh3_64_intdigest(piece) % len(self.seeds)]
        slot = -seed - 1 if seed < 0 else xxhash.xxh3_64_intdigest(piece, seed) % len(self.slot_ids)
        found = self.slot_ids[slot]
        return found if self.tokens[found] == piece else -1

    def merged(self, piece: bytes) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until none is left.

        A token lies at its first byte; ``end`` leads to the next one, ``before`` to the one before. A heap entry is stale
        when its left token is gone or its right token no longer ends where it did.
        """
        n, rank_of = len(piece), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(rank, i) for i in range(n - 1) if (rank := rank_of(piece[i:i + 2])) is not None]
        stops = [i + 2 for i in range(n)]  # where the pair at i ends for which the heap holds a valid entry
        heapify(heap)
        while heap:
            rank, left = heappop(heap)
            right = end[left]
            if right <= 0 or right >= n:
                continue
            stop = end[right]
            if stop != stops[left] or rank_of(piece[left:stop]) != rank:
                continue
            end[left], end[right] = stop, 0
            if stop < n:
                before[stop] = left
                stops[left] = further = end[stop]
                if (found := rank_of(piece[left:further])) is not None:
                    heappush(heap, (found, left))
            earlier = before[left]
            if earlier >= 0:
                stops[earlier] = stop
                if (found := rank_of(piece[earlier:stop])) is not None:
                    heappush(heap, (found, earlier))
        ids, at = [], 0
        while at < n:
            ids.append(self.ranks[piece[at:end[at]]])
            at = end[at]
        return ids

    def ids_of(self, piece: str) -> bytes:
        raw = piece.encode()
        found = self.whole(raw)
        return array("I", [found] if found >= 0 else self.merged(raw)).tobytes()

    def part(self, text: str) -> bytes:
        """Ids of a text or part, each as four little-endian bytes."""
        split = self.split if text.isascii() or not self.disputed(text) else self.exact_split
        return b"".join(map(self.ids_of, split(text)))

    def spaced(self, part: str) -> bytes:
        """Ids of a part with its space; letters alone are one pre-token."""
        return self.ids_of(" " + part) if latin(part) else self.part(" " + part)

    def encode(self, text: str) -> bytes:
        return joined(text, self.part, self.memo)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds ``out_col``: the text's token ids as little-endian unsigned 32-bit integers.

    Null text gives no ids. Other columns stay as they are, except that an earlier ``out_col`` is replaced; rows are
    neither merged nor reordered. The codec is broadcast: its size is the vocabulary's.
    """
    held = docs.drop(out_col)
    shared = docs.sparkSession.sparkContext.broadcast(codec(ranks_path, pattern))
    schema = held.withColumn(out_col, F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in small_batches(batches):
            at = batch.schema.get_field_index(text_col)
            ids = [coder.encode(text or "") for text in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], [*batch.schema.names, out_col])

    return held.mapInArrow(run, schema)


def decode(rows: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``: the bytes that the ids of ``ids_col`` stand for; null ids give no bytes."""
    held = rows.drop(out_col)
    shared = rows.sparkSession.sparkContext.broadcast(codec(ranks_path, pattern))
    schema = held.withColumn(out_col, F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in small_batches(batches):
            at = batch.schema.get_field_index(ids_col)
            text = [coder.decode(ids or b"") for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.binary())], [*batch.schema.names, out_col])

    return held.mapInArrow(run, schema)
