"""Similarity join, clusters and graph measures against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from murkwatch.operators import dna, graph
from murkwatch.session import cut_lineage


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    out = [" ".join(rng.choices(words, k=rng.randint(2, 8))) for _ in range(60)]
    return out + [out[0]] * 30 + [out[1]] * 5  # hot groups of copies


def _setup(spark, texts):
    df = spark.createDataFrame([(f"e{i:03d}", t) for i, t in enumerate(texts)], "event_id string, t string")
    w = dna.tfidf(df.select("event_id", dna.tokens(F.col("t")).alias("terms")), "event_id", F.col("terms"))
    vec = {}
    for r in w.collect():
        vec.setdefault(r.event_id, {})[r.term] = r.weight
    return dna.vectors(w, "event_id"), vec


def _cos(a, b):
    return sum(x * b.get(t, 0.0) for t, x in a.items())


@pytest.mark.parametrize("block", [2000, 3])
def test_pairs_equal_brute_force(spark, texts, block, monkeypatch):
    monkeypatch.setattr(dna, "BLOCK", block)  # small blocks exercise the block-pair split
    (vecs, members), vec = _setup(spark, texts)
    ids = [r.vid for r in vecs.select("vid").collect()]
    want = {(a, b) for a, b in itertools.combinations(sorted(ids), 2) if _cos(vec[a], vec[b]) >= 0.3}
    got = [(r.a, r.b) for r in dna.similar_pairs(vecs, 0.3).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert members.count() == len(texts)


def test_clusters_equal_union_find(spark, texts):
    (vecs, members), vec = _setup(spark, texts)
    parent = {k: k for k in vec}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(vec), 2):
        if _cos(vec[a], vec[b]) >= 0.5 - 1e-9:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k in vec:
        groups.setdefault(find(k), set()).add(k)
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    got = {}
    assigned = dna.clusters(vecs, members, "event_id")
    for r in assigned.collect():
        got.setdefault(r.component, set()).add(r.event_id)
    assert {frozenset(g) for g in got.values()} == want
    ids = {r.component: r for r in dna.campaign_ids(assigned, "event_id").collect()}
    assert all(ids[c].event_count == len(m) for c, m in got.items())
    again = {r.component: r.campaign_id for r in dna.campaign_ids(assigned.repartition(7), "event_id").collect()}
    assert again == {c: r.campaign_id for c, r in ids.items()} and len(set(again.values())) == len(ids)


def test_spanning_links_stay_few_in_a_hot_group(spark):
    """Near copies of one text: components come from links with centres, not from the group's pairs."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(w if rng.random() > 0.04 else f"x{rng.randrange(500)}" for w in base) for _ in range(150)] + [" ".join(rng.choices([f"v{i}" for i in range(60)], k=12)) for _ in range(40)]
    (vecs, _), vec = _setup(spark, texts)
    labels, links = dna.linked_components(vecs, 0.5)
    ids = sorted(r.vid for r in vecs.select("vid").collect())
    pairs = [(a, b) for a, b in itertools.combinations(ids, 2) if _cos(vec[a], vec[b]) >= 0.5]
    group = {k: k for k in ids}
    for a, b in pairs:
        old, new = max(group[a], group[b]), min(group[a], group[b])
        group = {k: new if g == old else g for k, g in group.items()}
    assert {r.vid: r.component for r in labels.collect()} == group
    found = [(r.a, r.b) for r in links.collect()]
    assert len(found) == len(set(found)) and set(found) <= set(pairs) 
    assert len(found) < len(pairs) / 3


def test_no_candidate_pair_is_shuffled(spark):
    """A hot term: all its vectors meet, and only vectors are exchanged, each once per block."""
    texts = [f"hot w{i} x{i % 7}" for i in range(1200)]
    (vecs, _), _ = _setup(spark, texts)
    pairs = dna.similar_pairs(cut_lineage(vecs), 0.9)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert pairs.count() == 0


def test_dbscan_two_samples_equals_clusters(spark, texts):
    (vecs, members), _ = _setup(spark, texts)
    a = {(r.event_id, r.component) for r in dna.clusters(vecs, members, "event_id").collect()}
    b = {(r.event_id, r.component) for r in dna.dbscan(vecs, members, "event_id", 0.5, 2).collect()}
    assert a == b


def test_long_path_components(spark):
    n = 300
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = graph.connected_components(spark.range(n + 1), edges)
    assert {(r.component, r["count"]) for r in out.groupBy("component").count().collect()} == {(0, n), (n, 1)}


def test_graph_measures(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "a int, b int")
    v = spark.createDataFrame([(i,) for i in range(1, 6)], "id int")
    c = {r.id: r for r in graph.clustering_coefficients(v, edges).collect()}
    assert c[1].coefficient == 1.0 and c[3].coefficient == pytest.approx(1 / 3) and c[5].coefficient == 0.0
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)], "id int, component int")
    want = (3 / 4 - (7 / 8) ** 2) + (0 - (1 / 8) ** 2)
    assert graph.modularity(labels, edges).first().modularity == pytest.approx(want)


def test_char_ngrams(spark):
    got = spark.range(1).select(dna.char_ngrams(F.lit("ab c"))).first()[0]
    assert sorted(got) == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "])
