"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations make the whole signature: the first spreads shingles over positions, the second gives values, and
coordinate k reads the value k places further round. Equal sets collapse first. In each band bucket nodes are compared
with a centre, then with another one; what shares a component need not be compared again, so a bucket that a third of
all rows share costs a few comparisons a row. Nodes of buckets that still hold several components then meet by a prefix
filter over exact shingles, which loses no pair: first with centres of a shingle, more each round, as links with
them join most of what it holds, then with all that is left in other components. Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import cut_lineage, drop_table
from .shared import batches_of_bytes, id_and_text, small_batches

BANDS, ROWS = 25, 5
#: Positions of the circulant permutations.
POSITIONS = 1 << 20
#: Bits that mark the ids whose texts are read again: 4 MB, whatever the input.
MARKS = 1 << 25
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


@cache
def _circle() -> np.ndarray:
    """Row p holds the values at p, p+1, ... of the second permutation, round the circle."""
    values = np.random.default_rng(20240229).permutation(POSITIONS).astype(np.uint32)
    values = np.concatenate([values, values[:BANDS * ROWS]])
    return np.lib.stride_tricks.sliding_window_view(values, BANDS * ROWS)


class WordHashes(dict):
    """64-bit hashes of words, kept for those seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str, hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit names of the text's shingles; with fewer words than ``size`` the whole is one."""
    words = text.encode().lower().split()  # of bytes: A-Z only, and the six white-space characters only
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)] if words else [], dtype=np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    name = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for k in range(size):
        name = mixed(name * _MIX[3] + each[k:len(each) - size + 1 + k] + _MIX[0])
    return np.unique(name)


def bands(names: np.ndarray) -> bytes:
    """The keys of the bands: 8 bytes each."""
    spots = (mixed(names + _MIX[0]) & np.uint64(POSITIONS - 1)).astype(np.int64)
    circle, signature = _circle(), None
    for start in range(0, len(spots), 4096):
        least = circle[spots[start:start + 4096]].min(axis=0)
        signature = least if signature is None else np.minimum(signature, least)
    rows = signature.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * _MIX[3] + rows[:, k] + _MIX[0])
    return key.tobytes()


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """(row_id, doc_id, n_shingles, set_key, bands); set_key and bands are null for an empty set."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small_batches(batches):
            sets = [shingles(text, hashes, size) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array([bands(s) if len(s) else None for s in sets], pa.binary())],
                names=["row_id", "doc_id", "n_shingles", "set_key", "bands"])

    return docs.mapInArrow(run, f"row_id long, doc_id {id_type}, n_shingles long, set_key binary, bands binary")


def _marked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id shares its bit with a rep of ``wanted``: all of the wanted ones, and few others."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS)) + 1
    at = F.bitmap_bit_position(slot("doc_id"))
    marks = wanted.groupBy(F.bitmap_bucket_number(slot("rep")).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot("rep"))).alias("_bits"))
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    met = (F.bitmap_bucket_number(slot("doc_id")) == F.col("_bucket")) & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return docs.join(F.broadcast(marks), met, "left_semi")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the nodes of ``wanted`` (node, rep, set_key), made again from their documents' texts.

    Only texts of marked ids are exchanged.
    """
    met = _marked(docs, wanted).join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "set_key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small_batches(batches):
            nodes, made = [], []
            for node, key, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                names = shingles(text, hashes, size).tobytes()
                if xxhash.xxh3_128_digest(names) == key:  # else another row of the same doc_id
                    nodes.append(node)
                    made.append(names)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(made, pa.binary())], names=["node", "shingles"])

    return met.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets satisfy 100 * intersection >= percent * union."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            same = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                same.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(same, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return two.mapInArrow(run, "a long, b long")


def _prefixes(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, node, n, left): the prefixes of the sets of ``nodes`` (node, n).

    Prefix filter: with shingles ordered by how many nodes have them, rarest first, two similar sets share one among the
    first n - ceil(n * percent / 100) + 1 of either. ``left`` counts what a set holds from the shingle on.
    """
    own = nodes.join(sets, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_bytes(batches):
            lists = [np.frombuffer(raw, np.int64) for raw in batch.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(lists)), [len(names) for names in lists]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(at) for k in range(2)), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))],
                names=["node", "n", "shingle"])

    each = own.select("node", "n", "shingles").mapInArrow(run, "node long, n long, shingle long")
    common = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    held = each.join(common, "shingle")
    order = Window.partitionBy("node").orderBy("df", "shingle")
    rare = F.col("n") - F.count("*").over(Window.partitionBy("node"))
    prefix = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    ranked = held.withColumns({"place": F.row_number().over(order) + rare}).where(F.col("place") <= prefix)
    return ranked.select("shingle", "node", "n", (F.col("n") - F.col("place") + 1).alias("left"))


def _split(held: DataFrame, key: str) -> DataFrame:
    """The rows of the keys that still hold several components."""
    several = held.groupBy(key).agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select(key)
    return held.join(several, key)


def _side(rows: DataFrame, letter: str) -> DataFrame:
    return rows.select("shingle", F.col("node").alias(letter), *[F.col(c).alias(f"{c}_{letter}") for c in ("n", "component", "left")])


def _fits(percent: int) -> Column:
    """Whether two sets that first meet at a shingle can be similar: the overlap is what is left of the shorter rest at most."""
    return (100 + percent) * F.least("left_a", "left_b") >= percent * (F.col("n_a") + F.col("n_b"))


def _with_centres(live: DataFrame, percent: int, centres: int) -> DataFrame:
    """Pairs of each node with about ``centres`` of its shingle, drawn by hash; one at least.

    Of two sets that fit the smaller one also fits one of its own size, so centres are drawn from these.
    """
    able = (100 + percent) * F.col("left") >= 2 * percent * F.col("n")
    drawn = live.withColumn("draw", F.when(able, F.pmod(F.xxhash64(F.lit(centres), "node"), F.lit(1 << 30))))
    lots = drawn.groupBy("shingle").agg(F.count("draw").alias("m"), F.min("draw").alias("first")).where("m > 0")
    chosen = (F.col("draw") == F.col("first")) | (F.col("draw") * F.col("m") < F.lit(centres << 30))
    drawn = drawn.join(lots, "shingle").where(chosen)
    return _side(live, "a").join(_side(drawn, "b"), "shingle").where((F.col("component_a") != F.col("component_b")) & _fits(percent))


def _all_pairs(live: DataFrame, percent: int) -> DataFrame:
    """All pairs of a shingle that lie in different components: nodes outside its most frequent component meet all others."""
    counts = live.groupBy("shingle", "component").agg(F.count("*").alias("m"))
    most = counts.groupBy("shingle").agg(F.max(F.struct("m", "component"))["component"].alias("most"))
    outside = live.join(most, "shingle").where("component <> most")
    return _side(outside, "a").join(_side(live, "b"), "shingle").where((F.col("component_a") != F.col("component_b")) & _fits(percent))


def _pairs_ahead(live: DataFrame) -> tuple[int, int]:
    """Rows of ``live``, and the rows that all pairs of its shingles would make."""
    counts = live.groupBy("shingle", "component").agg(F.count("*").alias("m")).groupBy("shingle").agg(F.sum("m").alias("all"), F.max("m").alias("most"))
    product = (F.col("all") - F.col("most")).cast("decimal(19,0)") * F.col("all").cast("decimal(19,0)")
    row = counts.agg(F.sum("all").alias("rows"), F.sum(product).alias("pairs")).first()
    return int(row.rows or 0), int(row.pairs or 0)


def _near(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs whose sizes allow a link."""
    return (pairs.where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (F.col("a") != F.col("b")))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after ``links`` (a, b). Only components that links touch take part in the rounds."""
    left, right = (labels.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}")) for end in ("a", "b"))
    met = cut_lineage(links.join(left, "a").join(right, "b").where("c_a <> c_b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct())
    touched = met.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    roots = connected_components(touched, met).select(F.col("id").alias("component"), F.col("component").alias("root"))
    return cut_lineage(labels.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component")))


def components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each input row.

    A-Z are lower-cased; words are runs of characters other than space, tab, line feed, vertical tab, form feed and
    carriage return. A set holds the distinct shingles of ``size`` words, or the whole sequence if it is shorter.
    Documents are linked when 100 * intersection >= ``percent`` * union. component_id is the smallest doc_id that links
    reach; kept marks the rows with that doc_id (all of them where ids repeat). Null text and text without words give an
    empty set and no links: such a row is its own component. Null ids never are component ids unless no other is there.
    Shingles are named by 64 bits. At a similarity of 0.85 a link is found with probability 1 - 4.3e-7, above that with more.
    """
    rows = id_and_text(docs, id_col, text_col)
    signed = cut_lineage(_signed(rows.withColumn("row_id", F.monotonically_increasing_id()), size))
    nodes = cut_lineage(signed.where("n_shingles > 0").groupBy("set_key").agg(
        F.min("row_id").alias("node"), F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands")))

    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substr("bands", 8 * i + 1, F.lit(8)))
    entries = nodes.select("node", "n", F.explode(keys).alias("band"))
    shared = entries.groupBy("band").agg(
        F.count("*").alias("members"), F.min(F.struct("node", "n")).alias("low"), F.max(F.struct("node", "n")).alias("high")).where("members > 1")
    buckets = cut_lineage(entries.join(shared, "band"))
    wanted = cut_lineage(nodes.join(buckets.select("node").distinct(), "node").select("node", "rep", "set_key"))
    sets = cut_lineage(_sets(rows, wanted, size))

    # Nodes of no shared bucket have no links, so rounds carry labels of the others only.
    labels = wanted.select("node", F.col("node").alias("component"))
    tested = None

    def confirmed(found: DataFrame) -> DataFrame:
        """The links among pairs that were not tested before."""
        nonlocal tested
        pairs = _near(found, percent)
        pairs = cut_lineage(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        tested = pairs if tested is None else tested.union(pairs)
        return cut_lineage(_linked(pairs, sets, percent))

    found = buckets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("low.node").alias("b"), F.col("low.n").alias("n_b"))
    labels = _merged(labels, confirmed(found))
    # Only buckets that still hold several components go on.
    held = cut_lineage(_split(buckets.join(labels, "node"), "band"))
    other = labels.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    found = (held.join(other, F.col("high.node") == F.col("_node")).where("component <> _component")
             .select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("high.node").alias("b"), F.col("high.n").alias("n_b")))
    labels = _merged(labels, confirmed(found))
    held = cut_lineage(_split(held.drop("component").join(labels, "node"), "band").select("node", "n").distinct())
    live = cut_lineage(_split(_prefixes(held, sets, percent).join(labels, "node"), "shingle"))
    # Links draw a shingle's components together, so nodes first meet one centre of it, then more, four times as many each round,
    # as long as that takes fewer rows than all pairs of what is still apart. Shingles left with one component are done.
    centres = 1
    while True:
        rows, ahead = _pairs_ahead(live)
        if rows * centres >= ahead:
            break
        labels, centres, before = _merged(labels, confirmed(_with_centres(live, percent, centres))), 4 * centres, live
        live = cut_lineage(_split(before.drop("component").join(labels, "node"), "shingle"))
        drop_table(before)
    if rows:
        labels = _merged(labels, confirmed(_all_pairs(live, percent)))

    named = nodes.join(labels, "node", "left").select("set_key", "rep", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    by_set = named.join(least, "component").select("set_key", "least")
    out = signed.join(by_set, "set_key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_representatives(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, columns as they are; rows whose doc_id repeats go or stay together."""
    kept = components(docs, size, percent, id_col, text_col).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
