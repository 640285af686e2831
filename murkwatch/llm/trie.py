"""The trie of conversation prefixes, and what sharing them saves, by the Euler tour of the tree.

A prefix is named by its depth and by two sums (exclusive or) of hashes of its turns, so prefixes of one conversation come from
prefix sums in chunks. A node is called by its smallest member and its depth. Every node has two arcs, one that enters it
and one that leaves it; each knows the next arc of the tour: the first child, the next sibling or the way back to the
parent. List ranking finds where arcs lie on the tour: blocks of arcs follow the list as far as they hold it, which leaves a
short list of heads; pairs of neighbours of a list that is still long merge by a coin; offsets are then handed back
level by level. With prefix sums of leaves and savings along the tour, a subtree's total is what lies between its arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_table
from .shared import shuffle_width

#: Turns of a conversation whose hashes are summed in one group.
CHUNK = 1024
#: Width of the ranges of identifiers in which siblings are linked, and members listed.
SLICE = 1024
#: Arcs that a block follows at once; a list of so many heads is finished by one block.
BLOCK = 1 << 16


# ---- conversations -----------------------------------------------------------

def ordered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv, place, role, digest, bytes): turns numbered from 1 within their conversation.

    Sorted ranges count what they hold of a conversation, and a conversation that goes on in the next range starts there
    with what earlier ranges counted; so a conversation of any length is numbered by many tasks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    keys = [F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("digest")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            place = np.arange(len(conv)) - np.repeat(starts, np.diff(np.r_[starts, len(conv)])) + 1
            if conv[0] == last:
                place[:starts[1] if len(starts) > 1 else len(conv)] += seen
            last, seen = conv[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * len(conv), pa.int32()), pa.array(place, pa.int64()), *(batch.column(k) for k in (2, 3, 4))],
                names=["conv", "part", "place", "role", "digest", "bytes"])

    ranges = rows.repartitionByRange(shuffle_width(rows), *keys).sortWithinPartitions(*keys)
    local = cut_lineage(ranges.mapInArrow(run, "conv long, part int, place long, role string, digest binary, bytes long"))
    held = local.groupBy("conv", "part").agg(F.max("place").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Only the first conversation of a range can have begun earlier: one row a range at most.
    begun = F.broadcast(held.select("conv", "part", before.alias("before")).where("before is not null"))
    return local.join(begun, ["conv", "part"], "left").select(
        "conv", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "role", "digest", "bytes")


def rebuilt_turns(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """(conv, depth, total, role, digest, bytes): the first h turns of conversation c - c % family, then c's own after its first h.

    h is crc32(c) % most. A row of depth 0 stands for each conversation, turnless ones included; total is its number of turns.
    c % family has the sign of c.
    """
    own = turns.groupBy("conv").agg(F.max("place").alias("own"))
    convs = own.select("conv", "own", (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"),
                       (F.col("conv") - F.col("conv") % family).alias("base"))
    lent = own.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    shared = F.least("h", F.coalesce("base_own", F.lit(0)))
    convs = cut_lineage(convs.join(lent, "base", "left").select(
        "conv", "h", "base", shared.alias("shared"), (shared + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")))
    first = turns.where(F.col("place") < most).withColumnRenamed("conv", "base").join(convs, "base").where("place <= shared").select(
        "conv", F.col("place").alias("depth"), "total", "role", "digest", "bytes")
    rest = turns.join(convs, "conv").where("place > h").select(
        "conv", (F.col("place") - F.col("h") + F.col("shared")).alias("depth"), "total", "role", "digest", "bytes")
    none = convs.select("conv", F.lit(0).cast("long").alias("depth"), "total", F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return none.unionByName(first).unionByName(rest)


# ---- nodes -------------------------------------------------------------------

def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, total, bytes, p1, p2, q1, q2): the names of a turn's prefix and of the prefix before it."""
    marks = [F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(k), "depth", "role", "digest")).alias(f"m{k}") for k in (1, 2)]
    marked = turns.select("conv", "depth", "total", "bytes", *marks, F.floor((F.col("depth") - 1) / CHUNK).alias("chunk"))
    inside = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = cut_lineage(marked.withColumns({f"p{k}": F.bit_xor(f"m{k}").over(inside) for k in (1, 2)}))
    chunks = local.where(F.col("total") > CHUNK).groupBy("conv", "chunk").agg(*[F.bit_xor(f"m{k}").alias(f"t{k}") for k in (1, 2)])
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select("conv", "chunk", *[F.bit_xor(f"t{k}").over(earlier).alias(f"o{k}") for k in (1, 2)]).where("chunk > 0")
    whole = local.join(offsets, ["conv", "chunk"], "left")
    sums = {f"p{k}": F.col(f"p{k}").bitwiseXOR(F.coalesce(f"o{k}", F.lit(0).cast("long"))) for k in (1, 2)}
    whole = whole.select("conv", "depth", "total", "bytes", "m1", "m2", *[c.alias(name) for name, c in sums.items()])
    return whole.select("conv", "depth", "total", "bytes", "p1", "p2", *[F.col(f"p{k}").bitwiseXOR(F.col(f"m{k}")).alias(f"q{k}") for k in (1, 2)])


def _nodes(prefixes: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, first_child, bytes, p1, p2)."""
    name = ["depth", "p1", "p2"]
    nodes = cut_lineage(prefixes.groupBy(*name).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("q1").alias("q1"), F.min("q2").alias("q2")))
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(below, name, "left").join(parents, ["depth", "q1", "q2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "first_child", "bytes", "p1", "p2")


def _ends(prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): the digest of the members that end at a node, in ascending order.

    Members are listed by ranges of identifiers; a digest reads the lists of its node one after the other and holds its state only.
    """
    name = ["depth", "p1", "p2"]
    slices = prefixes.where("depth = total").groupBy(*name, F.floor(F.col("conv") / SLICE).alias("slice")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*(pa.array([value], pa.int64()) for value in current), pa.array([digest.hexdigest()], pa.string())], names=[*name, "ends_sha256"])

        for batch in batches:
            for *key, members in zip(*(column.to_pylist() for column in batch.columns)):
                if key == current:
                    digest.update(b"," + members.encode())
                else:
                    if current is not None:
                        yield closed()
                    current, digest = key, hashlib.sha256(members.encode())
        if current is not None:
            yield closed()

    digests = slices.repartition(shuffle_width(slices), *name).sortWithinPartitions(*name, "slice").select(*name, "members").mapInArrow(
        run, "depth long, p1 long, p2 long, ends_sha256 string")
    none = hashlib.sha256(b"").hexdigest()
    return nodes.select("conv_id", *name).join(digests, name, "left").select("conv_id", "depth", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


# ---- tour --------------------------------------------------------------------

def _siblings(nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, next): the next child of the same parent, in the order of identifiers.

    Links are made within ranges of identifiers, and from the last child of a range to the first one of the next range that has any.
    """
    kids = nodes.where("depth > 0").select("conv_id", "depth", "parent_conv_id", F.floor(F.col("conv_id") / SLICE).alias("slice"))
    part = ["parent_conv_id", "depth", "slice"]
    after = F.lead("conv_id").over(Window.partitionBy(*part).orderBy("conv_id"))
    lows = kids.groupBy(*part).agg(F.min("conv_id").alias("low"))
    lows = lows.select(*part, F.lead("low").over(Window.partitionBy("parent_conv_id", "depth").orderBy("slice")).alias("next_low"))
    return kids.withColumn("after", after).join(lows, part).select("conv_id", "depth", F.coalesce("after", "next_low").alias("next"))


def euler_arcs(nodes: DataFrame) -> DataFrame:
    """(conv, arc, next_conv, next_arc, leaves, saved): the arcs 2 * depth (in) and 2 * depth + 1 (out) of each node.

    The last arc, out of the root, has no next one. Weights lie on the arcs that enter.
    """
    linked = nodes.join(_siblings(nodes), ["conv_id", "depth"], "left")
    down, out = 2 * F.col("depth"), 2 * F.col("depth") + 1
    zero = F.lit(0).cast("long")
    enter = F.struct(
        F.col("conv_id").alias("conv"), down.alias("arc"), F.coalesce("first_child", "conv_id").alias("next_conv"),
        F.when(F.col("n_children") > 0, down + 2).otherwise(out).alias("next_arc"), (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    leave = F.struct(
        F.col("conv_id").alias("conv"), out.alias("arc"), F.coalesce("next", "parent_conv_id").alias("next_conv"),
        F.when(F.col("next").isNotNull(), down).when(F.col("depth") > 0, out - 2).alias("next_arc"), zero.alias("leaves"), zero.alias("saved"))
    return linked.select(F.inline(F.array(enter, leave)))


_WEIGHTS = ["steps", "leaves", "saved"]
#: The columns of a list: an element's name, the next one's, and what the element weighs.
_LIST = ["conv", "arc", "next_conv", "next_arc", *_WEIGHTS]
#: An element, the head of its stretch, what follows a stretch (on its last element) and the sums from the head on.
_LEVEL = ["conv", "arc", "head_conv", "head_arc", "next_conv", "next_arc", *_WEIGHTS]


def _follow(piece: pa.Table) -> pa.RecordBatch:
    """Follows the list within a block: a stretch goes on as long as the next element is here."""
    columns = [piece.column(name).to_pylist() for name in _LIST]
    names, nexts, weights = list(zip(*columns[:2])), list(zip(*columns[2:4])), list(zip(*columns[4:]))
    place = {name: k for k, name in enumerate(names)}
    follows = [place.get(name, -1) for name in nexts]
    inner = set(follows)
    heads, sums = [names[0]] * len(names), [(0, 0, 0)] * len(names)
    for start, head in enumerate(names):
        at, total = -1 if start in inner else start, (0, 0, 0)
        while at >= 0:
            total = tuple(a + b for a, b in zip(total, weights[at]))
            heads[at], sums[at] = head, total
            at = follows[at]
    after = [name if k < 0 else (None, None) for name, k in zip(nexts, follows)]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(values, pa.int64()) for group in (names, heads, after, sums) for values in zip(*group)), pa.array([k < 0 for k in follows], pa.bool_())],
        names=[*_LEVEL, "last"])


def _by_blocks(items: DataFrame) -> DataFrame:
    """The partitions of ``items`` in blocks, each followed for itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > BLOCK:
                yield _follow(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield _follow(pa.Table.from_batches(held))

    return items.select(*_LIST).mapInArrow(run, ", ".join(f"{c} long" for c in _LEVEL) + ", last boolean")


def _by_coins(items: DataFrame, round_: int) -> DataFrame:
    """An element with heads takes up the next one if that has tails: about a quarter of any list goes."""
    tossed = items.select(*_LIST, F.pmod(F.xxhash64(F.lit(round_), "conv", "arc"), F.lit(2)).alias("coin"))
    tails = tossed.where("coin = 1")
    taken = tails.select(*[F.col(c).alias(f"t_{c}") for c in _LIST])
    by = tossed.where("coin = 0").join(taken, (F.col("next_conv") == F.col("t_conv")) & (F.col("next_arc") == F.col("t_arc")), "left")
    met = F.col("t_conv").isNotNull()
    head = [F.col("conv").alias("head_conv"), F.col("arc").alias("head_arc")]
    first = by.select("conv", "arc", *head, F.when(~met, F.col("next_conv")).alias("next_conv"),
                      F.when(~met, F.col("next_arc")).alias("next_arc"), *_WEIGHTS, (~met).alias("last"))
    second = by.where(met).select(
        F.col("t_conv").alias("conv"), F.col("t_arc").alias("arc"), *head, F.col("t_next_conv").alias("next_conv"),
        F.col("t_next_arc").alias("next_arc"), *[(F.col(w) + F.col(f"t_{w}")).alias(w) for w in _WEIGHTS], F.lit(True).alias("last"))
    alone = tails.join(second.select("conv", "arc"), ["conv", "arc"], "left_anti").select(
        "conv", "arc", *head, "next_conv", "next_arc", *_WEIGHTS, F.lit(True).alias("last"))
    return first.unionByName(second).unionByName(alone)


def _stretches(level: DataFrame) -> DataFrame:
    """The shorter list of a level's stretches, each named by its head."""
    return level.where("last").select(F.col("head_conv").alias("conv"), F.col("head_arc").alias("arc"), "next_conv", "next_arc", *_WEIGHTS)


def list_rank(items: DataFrame, bound: int = BLOCK) -> DataFrame:
    """(conv, arc, steps, leaves, saved): the sums along the list up to and with each element.

    ``items`` holds conv, arc (an element's name), next_conv, next_arc (null at the end) and the weights steps, leaves, saved.
    Blocks of neighbouring names and coins shorten the list in turn until at most ``bound`` stretches are left, which one
    block follows. Coins shorten any list, so rounds grow with the logarithm of its length. Then offsets go back, level by level.
    """
    width, levels, current = shuffle_width(items), [], items
    while True:
        if len(levels) % 2:
            level = _by_coins(current, len(levels))
        else:
            level = _by_blocks(current.repartitionByRange(width, "conv", "arc").sortWithinPartitions("conv", "arc"))
        levels.append(cut_lineage(level))
        current = _stretches(levels[-1])
        if current.count() <= bound:
            break
    ranked = _by_blocks(current.coalesce(1)).select("conv", "arc", *_WEIGHTS)
    for level in reversed(levels):
        ends = _stretches(level).select("conv", "arc", *[F.col(w).alias(f"all_{w}") for w in _WEIGHTS])
        before = ranked.join(ends, ["conv", "arc"]).select(
            F.col("conv").alias("head_conv"), F.col("arc").alias("head_arc"), *[(F.col(w) - F.col(f"all_{w}")).alias(f"before_{w}") for w in _WEIGHTS])
        ranked = cut_lineage(level.join(before, ["head_conv", "head_arc"]).select(
            "conv", "arc", *[(F.col(w) + F.col(f"before_{w}")).alias(w) for w in _WEIGHTS]))
        drop_table(level)
    return ranked


# ---- result ------------------------------------------------------------------

def prefix_trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row for each distinct prefix.

    ``turns`` has the columns of ``rebuilt_turns``: depths 0 to total without gaps for each conversation. A node is called by its
    smallest member. n_leaves counts childless nodes of the subtree, saved_tokens sums (members - 1) * bytes of the last turn
    over it; both include the node. ends_sha256 is the digest of the members of exactly ``depth`` turns. No turns, no rows.
    """
    prefixes = cut_lineage(_prefixes(turns))
    nodes = cut_lineage(_nodes(prefixes))
    ranked = list_rank(euler_arcs(nodes).withColumn("steps", F.lit(1).cast("long")))
    within = [(F.max(F.when(F.col("arc") % 2 == 1, F.col(c))) - F.max(F.when(F.col("arc") % 2 == 0, F.col(c)))).alias(c) for c in ("leaves", "saved")]
    subtrees = ranked.groupBy(F.col("conv").alias("conv_id"), F.floor(F.col("arc") / 2).alias("depth")).agg(*within)
    own_leaf, own_saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    return nodes.join(subtrees, ["conv_id", "depth"]).join(_ends(prefixes, nodes), ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"),
        (F.col("leaves") + own_leaf).alias("n_leaves"), (F.col("saved") + own_saved).alias("saved_tokens"), "ends_sha256")


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text") -> DataFrame:
    """The nodes of ``prefix_trie`` over the rebuilt conversations.

    Turns are ordered by turn, null first; equal turns of a conversation by role and by md5 of the text. Null roles and texts
    become empty; rows without an identifier belong to no conversation and are left out. Repeated rows are turns of their
    own. An empty table has no conversations and gives no rows. Other columns are not read.
    """
    return prefix_trie(rebuilt_turns(cut_lineage(ordered_turns(conversations, id_col, turn_col, role_col, text_col))))
