"""Removal of repeated word windows by recompression.

Every document is parsed in rounds: runs of equal symbols become one symbol, then neighbours of opposite halves of the
alphabet are paired; the halves are drawn anew each round from the names. A name is the 64-bit digest of what it stands
for, so all tasks give equal content equal names without an exchange of dictionaries. Each symbol carries the words that
decide it: inside a window only symbols decided within the window count, and these are the same wherever the window's
words stand. Of the highest round that has one, the longest such symbol represents the window.

Spark then brings equal names together. A window whose symbol occurs once is unique; most of a corpus ends here. Among
occurrences of a shared symbol, windows are compared by digests of their words, and what occurs twice is covered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import BATCH_BITS, answered, exchanged, five_bytes, from_five_bytes, shared_names, told
from .minhash import WordHashes, mixed
from .shared import id_and_text, shuffle_width, small_batches

TOP, LOWEST = 3, 2
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_ONE = np.uint64(1)


def _times(factor: np.uint64, n: int) -> np.uint64:
    return np.uint64(int(factor) * n % (1 << 64))


class Parse:
    """One round's symbols of many documents: name, how many words it stands for, the words [low, high] that decide it,
    and its document."""

    def __init__(self, name, words, low, high, doc, below, above):
        self.name, self.words, self.low, self.high, self.doc = name, words, low, high, doc
        self.below, self.above = below, above  # of each document: the places before its first and after its last word

    def left(self, at):
        """low of the symbol before, or the place before the document."""
        before = np.maximum(at - 1, 0)
        inside = (at > 0) & (self.doc[before] == self.doc[at])
        return np.where(inside, self.low[before], self.below[self.doc[at]])

    def right(self, at):
        after = np.minimum(at + 1, len(self.name) - 1)
        inside = (at + 1 < len(self.name)) & (self.doc[after] == self.doc[at])
        return np.where(inside, self.high[after], self.above[self.doc[at]])

    def runs(self) -> Parse:
        """Whether a symbol is a run, and of what length, its neighbours decide too."""
        new = np.ones(len(self.name), dtype=bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(new)
        count = np.diff(first, append=len(self.name))
        name = self.name[first]
        name = np.where(count > 1, mixed(name * _B + count.astype(np.uint64)), name)
        return Parse(name, np.add.reduceat(self.words, first), self.left(first), self.right(first + count - 1), self.doc[first], self.below, self.above)

    def pairs(self, turn: int) -> Parse:
        """A left-half symbol joins a right-half one behind it. One that stays alone is decided by the neighbour it could
        have joined."""
        half = (mixed(self.name + _times(_C, turn)) >> np.uint64(33)) & _ONE == 1
        opens = np.zeros(len(half), dtype=bool)
        opens[:-1] = ~half[:-1] & half[1:] & (self.doc[:-1] == self.doc[1:])
        closes = np.zeros(len(half), dtype=bool)
        closes[1:] = opens[:-1]
        kept = np.flatnonzero(~closes)
        pair, after = opens[kept], np.minimum(kept + 1, len(half) - 1)
        name = np.where(pair, mixed(self.name[kept] * _B + self.name[after] + _A), self.name[kept])
        low = np.where(half[kept], self.left(kept), self.low[kept])
        high = np.where(half[kept], self.high[kept], self.right(kept))
        words = self.words[kept] + np.where(pair, self.words[after], 0)
        return Parse(name, words, low, np.where(pair, self.high[after], high), self.doc[kept], self.below, self.above)


def window_digests(name: np.ndarray, width: int) -> np.ndarray:
    """Digests of all runs of ``width`` neighbouring names, wherever they stand; those across documents mean nothing."""
    if len(name) < width:
        return np.zeros(0, dtype=np.uint64)
    power = np.cumprod(np.concatenate([[_ONE], np.full(len(name) - 1, _B)]))
    inverse = np.cumprod(np.concatenate([[_ONE], np.full(len(name) - 1, np.uint64(pow(int(_B), -1, 1 << 64)))]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(name * power)])
    return mixed((total[width:] - total[:-width]) * inverse[:len(name) - width + 1])


def representatives(name: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, last window) of the symbols that represent the windows; windows count by their first word.

    ``name`` holds the word names of several documents of ``sizes`` words each.
    """
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    windows = np.arange(len(name))
    windows = windows[windows + width <= ends[doc]] if len(name) else windows
    if not len(windows):
        return np.zeros(0, np.uint64), windows, windows
    places = np.arange(len(name))
    parse = Parse(name, np.ones(len(name), dtype=np.int64), places, places, doc, ends - sizes - 1, ends)
    levels = []
    for turn in range(1, TOP + 1):
        parse = parse.runs().pairs(turn)
        levels.append(parse)
    symbol = np.zeros(len(windows), dtype=np.uint64)
    at = np.full(len(windows), -1)
    open_ = np.arange(len(windows))
    for level in range(TOP, LOWEST - 1, -1):
        parse = levels[level - 1]
        start = windows[open_]
        first, stop = np.searchsorted(parse.low, start), np.searchsorted(parse.high, start + width - 1, side="right")
        # The longest symbol first, as it is the rarest; then the least name.
        order = (np.uint64(63) - np.minimum(parse.words, 63).astype(np.uint64) << np.uint64(58)) | (parse.name >> np.uint64(6))
        has = stop > first
        chosen, first, stop = open_[has], first[has], stop[has]
        best = first.copy()
        for k in range(1, int((stop - first).max(initial=0))):
            other = np.minimum(first + k, stop - 1)
            best = np.where(order[other] < order[best], other, best)
        symbol[chosen] = mixed(parse.name[best] + _times(_A, level))
        at[chosen] = best * (TOP + 1) + level
        open_ = open_[~has]
    # A window without a symbol of its own, such as one inside a longer run, stands for itself.
    if len(open_):
        symbol[open_] = mixed(window_digests(name, width)[windows[open_]] + _C)
        at[open_] = -1 - open_
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
    heads = np.flatnonzero(new)
    return symbol[heads], windows[heads], windows[np.append(heads[1:], len(windows)) - 1]


def _named(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return mixed(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)) + _C)


def _parsed(texts: list[str], hashes: WordHashes, width: int) -> tuple[np.ndarray, ...]:
    """(symbol, document, first window, last window) of a batch, and the digests of all windows with each document's first word."""
    words = [text.encode().split() for text in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    name = _named([w for each in words for w in each], hashes)
    symbol, low, high = representatives(name, sizes, width)
    base = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)[low] if len(low) else low
    return symbol, doc, low - base[doc], high - base[doc], name, base


PACKED = "bucket int, batch long, windows binary, row_id long, check long, spans array<struct<low:int,high:int>>"
MARKS = "row_id long, check long, spans array<struct<low:int,high:int>>"
_SPANS = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))


def _check(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def _windows(rows: DataFrame, answers: DataFrame, width: int, buckets: int) -> DataFrame:
    """For each batch and bucket the window digests under shared symbols; for each document with one, its settled spans.

    What occurs twice within a batch is settled there and goes on once, with weight two, so a passage that very many
    documents share sends little.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("row_id")
        texts, ids = left.column("text").to_pylist(), left.column("row_id").to_pylist()
        symbol, doc, low, high, name, base = _parsed(texts, WordHashes(), width)
        low_name, bucket, inverse, count = exchanged(symbol, buckets)
        shared = shared_names(bucket, count, right, buckets)
        kept = np.flatnonzero(shared[inverse]) if len(symbol) else np.zeros(0, np.int64)
        digests = window_digests(name, width)
        seen: dict[tuple[int, bytes], list[tuple]] = {}
        for which, owner, a, b in zip(inverse[kept].tolist(), doc[kept].tolist(), low[kept].tolist(), high[kept].tolist()):
            at = int(base[owner])
            seen.setdefault((which, digests[at + a:at + b + 1].tobytes()), []).append((owner, a, b))
        settled: dict[int, list[dict]] = {int(owner): [] for owner in np.unique(doc[kept])}
        sent: dict[int, list[tuple]] = {}
        for (which, windows), places in seen.items():
            owner, a, _ = places[0]
            sent.setdefault(int(bucket[which]), []).append((int(low_name[which]), ids[owner] & ((1 << BATCH_BITS) - 1), a, min(2, len(places)), windows))
            if len(places) > 1:
                for owner, a, b in places:
                    settled[owner].append({"low": a, "high": b})
        n, m = len(sent), len(settled)
        return pa.table([
            pa.array(list(sent) + [None] * m, pa.int32()), pa.array([ids[0] >> BATCH_BITS if ids else None] * n + [None] * m, pa.int64()),
            pa.array([_packed(*zip(*items)) for items in sent.values()] + [None] * m, pa.binary()),
            pa.array([None] * n + [ids[owner] for owner in settled], pa.int64()),
            pa.array([None] * n + [_check(texts[owner]) for owner in settled], pa.int64()),
            pa.array([None] * n + list(settled.values()), _SPANS)], names=["bucket", "batch", "windows", "row_id", "check", "spans"])

    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, PACKED)


def _packed(names, owners, lows, times, windows) -> bytes:
    columns = [five_bytes(np.array(names, "<u8")), np.array(owners, "<u2"), np.array(lows, "<u4"), np.array(times, "u1"),
               np.array([len(w) // 8 for w in windows], "<u4")]
    return np.uint32(len(names)).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns) + b"".join(windows)


def _unpacked(raw: bytes) -> tuple[np.ndarray, ...]:
    """(name, owner, low, times, how many windows, digests)."""
    n, at = int(np.frombuffer(raw, "<u4", 1)[0]), 4
    out = [from_five_bytes(np.frombuffer(raw, np.uint8, 5 * n, at))]
    at += 5 * n
    for kind, size in (("<u2", 2), ("<u4", 4), ("u1", 1), ("<u4", 4)):
        out.append(np.frombuffer(raw, kind, n, at).astype(np.int64))
        at += n * size
    return (*out, np.frombuffer(raw[at:], "<u8"))


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: of each symbol's windows, those that occur twice; neighbours become one span."""

    def close(values: list[tuple[int, bytes]]) -> pa.RecordBatch:
        parts = [_unpacked(value) for _, value in values]
        name, owner, low, times, sizes, digests = (np.concatenate(column) for column in zip(*parts))
        row = np.repeat(np.array([batch << BATCH_BITS for batch, _ in values]), [len(part[0]) for part in parts]) + owner
        group, weight = np.repeat(name, sizes), np.repeat(times, sizes)
        order = np.lexsort((digests, group))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (digests[order][1:] != digests[order][:-1]) | (group[order][1:] != group[order][:-1])
        number = np.cumsum(new) - 1
        twice = np.zeros(len(order), dtype=bool)
        twice[order] = np.bincount(number, weight[order])[number] > 1
        item = np.repeat(np.arange(len(row)), sizes)
        place = (low - (np.cumsum(sizes) - sizes))[item] + np.arange(len(twice))
        joined = twice[:-1] & twice[1:] & (item[1:] == item[:-1])
        opens, shuts = twice.copy(), twice.copy()
        opens[1:] &= ~joined
        shuts[:-1] &= ~joined
        found: dict[int, list[dict]] = {}
        for at, a, b in zip(row[item[opens]].tolist(), place[opens].tolist(), place[shuts].tolist()):
            found.setdefault(at, []).append({"low": a, "high": b})
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int64()), pa.nulls(len(found), pa.int64()), pa.array(list(found.values()), _SPANS)],
            names=["row_id", "check", "spans"])

    held, current = [], None
    for piece in batches:
        yield piece.filter(piece.column(0).is_null()).select(["row_id", "check", "spans"])
        rest = piece.filter(piece.column(0).is_valid())
        for bucket, batch, value in zip(*(rest.column(k).to_pylist() for k in range(3))):
            if bucket != current:
                if held:
                    yield close(held)
                held, current = [], bucket
            held.append((batch, value))
    if held:
        yield close(held)


def covered(spans: list[dict], width: int) -> list[tuple[int, int]]:
    """Disjoint word ranges [start, stop) that the windows cover."""
    out: list[list[int]] = []
    for low, high in sorted((span["low"], span["high"]) for span in spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high + width)
        else:
            out.append([low, high + width])
    return [(start, stop) for start, stop in out]


def remove_repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256), one row for each input row.

    Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return. A word goes
    if a window of ``width`` words that covers it also starts anywhere else, in the same document or another, judged on the
    input. kept_text joins the other words by spaces where a word went and is null where none did (and without ``texts``);
    kept_sha256 is the digest of the kept words, so joined, in either case. Null text has no words. Windows are told apart
    by a name of 40 bits and its bucket and a digest of 64 bits. ``docs`` must give the same rows in the same order each
    time it is read, as stored tables do; the job stops with an error where it doesn't.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("row_id", F.monotonically_increasing_id())
    buckets = shuffle_width(docs)

    def names(batch: list[str]) -> np.ndarray:
        return _parsed(batch, WordHashes(), width)[0]

    answers = answered(told(rows.select("row_id", "text"), names, buckets), buckets)
    read = rows.select("row_id", "text").withColumn("batch", F.shiftright("row_id", BATCH_BITS))
    key = F.when(F.col("bucket").isNull(), F.xxhash64("row_id")).otherwise(F.xxhash64("bucket"))
    met = _windows(read, answers, width, buckets).repartition(buckets, key).sortWithinPartitions("bucket")
    marks = met.mapInArrow(_settled, MARKS).groupBy("row_id").agg(
        F.max("check").alias("check"), F.flatten(F.collect_list("spans")).alias("spans")).where(F.size("spans") > 0)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.join(marks, "row_id", "left").select("doc_id", "text", "spans", "check").mapInArrow(
        _removed(width, texts), f"doc_id {id_type}, n_words long, n_removed long, kept_text string, kept_sha256 string")


def _removed(width: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sizes, removed, kept, digests = [], [], [], []
            for text, spans, check in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                words, left, at, gone = text.encode().split(), [], 0, 0
                if spans and _check(text) != check:
                    raise RuntimeError("the documents came in another order when read again; give a stored table")
                for start, stop in covered(spans or [], width):
                    left += words[at:start]
                    at, gone = stop, gone + stop - start
                rest = b" ".join(left + words[at:])
                sizes.append(len(words))
                removed.append(gone)
                kept.append(rest.decode() if texts and gone else None)
                digests.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digests, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return run
