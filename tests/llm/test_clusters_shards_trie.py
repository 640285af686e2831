import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from murkwatch.llm import clustering, sharding, trie

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, id string, ids string, distance string"


def plain_clusters(rows, k, dimensions, rounds, scale):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in hashed[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centres = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    out = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in out:
        inertia[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), names[c]) for i, d, c in out)


def vectors(rng, n, dimensions):
    bases = [[rng.gauss(0, 1) for _ in range(dimensions)] for _ in range(5)]
    rows = [(i, [b + rng.gauss(0, 0.4) for b in rng.choice(bases)]) for i in range(n)]
    rows += [(1000 + i, list(rows[0][1])) for i in range(n // 2)]  # one vector in a third of all rows
    rows += [(2000, None), (2001, []), (2002, [1.0] * (dimensions - 1)), (2003, [None] + [0.0] * (dimensions - 1)),
             (2004, [float("nan")] * dimensions), (2005, [float("inf")] * dimensions), (None, [0.5] * dimensions), (None, [0.25] * dimensions),
             (7, [0.0] * dimensions), (7, [0.0] * dimensions), (2006, [-30.0] * dimensions), (2007, [600.0] * dimensions)]
    return rows


@pytest.mark.parametrize("k, rounds", [(16, 3), (5, 12), (1, 2)])
def test_clusters_equal_plain_rounds(spark, k, rounds):
    rows = vectors(random.Random(k), 240, 8)
    df = spark.createDataFrame([(i, v, 1, "x", "y", "z", "w") for i, v in rows], VECTORS).repartition(4)
    got = clustering.cluster(df, k, 8, rounds, 64)
    assert Counter(map(tuple, got.collect())) == plain_clusters(rows, k, 8, rounds, 64)


def test_clusters_of_few_or_no_vectors(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [4.0, 4.0])], "vec_id int, embedding array<double>")
    assert Counter(map(tuple, clustering.cluster(few, 16, 2).collect())) == plain_clusters([(1, [1, 2]), (2, [1, 2]), (3, [4, 4])], 16, 2, 3, 64)
    assert clustering.cluster(few.where("vec_id > 9"), 16, 2).count() == 0
    assert clustering.cluster(few, 16, 3).count() == 0
    with pytest.raises(Exception, match="smaller scale"):
        clustering.cluster(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), 2, 2).collect()


def test_heaps_leave_settled_vectors_alone():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-20, 20, (200, 4)), rng.integers(980, 1020, (200, 4))])
    centres = np.array([[0, 0, 0, 0], [1000, 1000, 1000, 1000]])
    block, _ = clustering.Block.first(x, centres)
    block = clustering.Block.unpacked(*block.packed())
    looked, scan = [], clustering._scan
    clustering._scan = lambda rows, c: looked.append(len(rows)) or scan(rows, c)
    try:
        block.advance(centres + 3, np.array([12.0, 12.0]))
        assert looked == []
        block.advance(centres + 900, np.array([3600.0, 3600.0]))
        assert looked == [400]
    finally:
        clustering._scan = scan
    assert sorted(row for heap in block.heaps for _, row in heap) == list(range(400))


# ---- shards ------------------------------------------------------------------

def test_shards_hold_every_row_once(spark, docs, stored, tmp_path):
    placed = sharding.shuffled(docs, 16).persist()
    rows = placed.select("row.doc_id", "row.text", "size", "shard", "slot", "row.kept").collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(stored)
    assert all(r.size == len((r.text or "").encode()) + 1 and r.kept == "b" for r in rows)
    held = defaultdict(list)
    for r in rows:
        held[r.shard].append(r.slot)
    assert sorted(held) == list(range(16))
    assert all(sorted(slots) == list(range(len(slots))) for slots in held.values())
    assert max(map(len, held.values())) - min(map(len, held.values())) <= 1
    folder = str(tmp_path / "shards")
    sharding.write_shards(placed, folder)
    for shard in (0, 15):
        table = pq.read_table(folder, filters=[("shard", "=", shard)])
        assert sorted(table.column("slot").to_pylist()) == sorted(held[shard])
    placed.unpersist()


def test_shuffle_equals_plain_form(spark, docs, nothing):
    """Buckets by the seeded hash, each in the order of hash and place, shuffled from its end, one behind the other."""
    buckets = 64
    rows = sharding._scattered(docs, 20, "doc_id", "text").select("row.doc_id", "_hash", "_at", sharding._bucket(buckets)).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["_hash"], r["_at"])):
        by[r.bucket].append(r.doc_id)
    expected = []
    for bucket in sorted(by):
        held, draw = by[bucket], np.random.default_rng([20, bucket])
        draws = draw.integers(0, np.arange(len(held), 1, -1))
        for i, j in zip(range(len(held) - 1, 0, -1), draws):
            held[i], held[j] = held[j], held[i]
        expected += held
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 4
    got = sharding.shuffled(docs, 7).orderBy("shard", "slot").collect()
    assert [r.row.doc_id for r in got] == expected
    other = sharding.shuffled(docs, 7, seed=21).orderBy("shard", "slot").collect()
    assert [r.row.doc_id for r in other] != expected
    assert sharding.shuffled(nothing).count() == 0


def test_shuffle_is_uniform(spark):
    """Each row reaches each of four places about equally often over seeds."""
    docs = spark.createDataFrame([(k, "same") for k in range(4)], "doc_id long, text string").coalesce(1)
    seen = Counter()
    for seed in range(12):
        for r in sharding.shuffled(docs, 4, seed=seed).collect():
            seen[(r.row.doc_id, r.shard)] += 1
    assert sum(seen.values()) == 48 and max(seen.values()) <= 9 and len(seen) >= 12
    orders = Counter(tuple(sharding.fisher_yates(3, np.random.default_rng(s))) for s in range(1200))
    assert len(orders) == 6 and min(orders.values()) > 140


# ---- trie --------------------------------------------------------------------

def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(path[:-1] for path in members if path)
    leaves, saved = Counter(), Counter()
    for path, convs in sorted(members.items(), key=lambda m: -len(m[0])):
        leaves[path] += not kids[path]
        saved[path] += (len(convs) - 1) * (len(path[-1][1].encode()) if path else 0)
        if path:
            leaves[path[:-1]] += leaves[path]
            saved[path[:-1]] += saved[path]
    return sorted((convs[0], len(p), members[p[:-1]][0] if p else -1, len(convs), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in convs if len(built[c]) == len(p)).encode()).hexdigest()) for p, convs in members.items())


def conversations(rng):
    said = ["hi", "hé llo", "", None, "x" * 500]
    rows = []
    for c in [*range(60), *range(2000, 2600, 7), -7, -3, 10**12]:
        rows += [(c, turn, rng.choice(["user", "assistant"]) if turn > 2 else "user", rng.choice(said[:3])) for turn in range(rng.randrange(1, 9))]
    rows += [(c, turn, "user", "common") for c in range(300, 420) for turn in range(3)]  # copies
    rows += [(70, None, "user", "b"), (70, None, "user", "a"), (70, 3, None, None), (70, 3, "user", "x" * 500), (70, 3, "user", "x" * 500), (None, 1, "user", "lost")]
    rows += [(71, turn, "user", f"t{turn % 3}") for turn in range(1500)]  # one long conversation
    return rows


def test_trie_equals_plain_form(spark):
    rows = conversations(random.Random(4))
    df = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], "conv_id long, turn long, role string, text string, conv string, depth int, place string")
    got = trie.conversation_trie(df.repartition(5))
    assert sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in got.collect()) == plain_trie(rows)


def test_trie_of_no_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).count() == 0
    one = trie.conversation_trie(spark.createDataFrame([(3, None, None, None)], schema)).collect()
    assert sorted((r.conv_id, r.depth, r.n_leaves) for r in one) == [(row[0], row[1], row[5]) for row in plain_trie([(3, None, None, None)])]


@pytest.mark.parametrize("n, bound", [(1, 3), (300, 90)])
def test_list_rank_of_scattered_names(spark, n, bound):
    """Names in random order: blocks hold short stretches only, and coins must shorten the list."""
    rng = random.Random(n + bound)
    names = [(rng.randrange(50), k) for k in range(n)]
    rng.shuffle(names)
    weights = [(1, rng.randrange(3), rng.randrange(100)) for _ in names]
    rows = [(*name, *(names[k + 1] if k + 1 < n else (None, None)), *weights[k]) for k, name in enumerate(names)]
    items = spark.createDataFrame(rows, "conv long, arc long, next_conv long, next_arc long, steps long, leaves long, saved long")
    got = {(r.conv, r.arc): (r.steps, r.leaves, r.saved) for r in trie.list_rank(items, bound).collect()}
    total, expected = (0, 0, 0), {}
    for name, weight in zip(names, weights):
        total = tuple(a + b for a, b in zip(total, weight))
        expected[name] = total
    assert got == expected
