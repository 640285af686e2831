"""Statistics against small exact cases and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from murkwatch.operators import evaluation as ev
from murkwatch.operators import isotonic, ranking
from murkwatch.operators import training as tr


def test_confusion_case(spark):
    t = ["HIGH", "CLEAN", "SUSPICIOUS", "HIGH", "CLEAN", "CLEAN"]
    p = ["HIGH", "HIGH", "CLEAN", "SUSPICIOUS", "CLEAN", "CLEAN"]
    r = ev.classification_metrics(spark.createDataFrame(list(zip(t, p)), "t string, p string"), "t", "p").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 2) and r.accuracy == pytest.approx(4 / 6)


def test_latency_case(spark):
    r = ev.latency_summary(spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40, 50)], "latency_ms double")).first()
    assert (r["mean"], r["median"]) == (30, 30) and r.p95 == pytest.approx(48.0) and r.p99 == pytest.approx(49.6)


def test_auc_and_quantiles_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.random() < 0.4, rng.choice([rng.random(), 0.5])) for _ in range(400)]
    df = spark.createDataFrame([(int(y), s) for y, s in rows], "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert ev.auc(df, "y", "s").first().auc == pytest.approx(want)
    got = ranking.quantiles(df, "s", {"q": 0.37}).first().q
    assert got == pytest.approx(df.agg(F.percentile("s", F.lit(0.37))).first()[0])


def test_delong(spark):
    rows = [(0, 0.1, 0.1), (0, 0.2, 0.2), (1, 0.8, 0.8), (1, 0.9, 0.9)]
    df = spark.createDataFrame(rows, "y int, a double, b double")
    r = ev.delong_ci(df, "y", "a").first()
    assert (r.auc, r.ci_lower, r.ci_upper) == (1.0, 1.0, 1.0)
    c = ev.delong_compare(df, "y", "a", "b").first()
    assert (c.z_statistic, c.p_value) == (0.0, 1.0)


@pytest.mark.parametrize("b,c,check", [
    (0, 0, lambda r: r.p_value == 1.0), (0, 2, lambda r: r.p_value < 1.0),
    (40, 20, lambda r: r.significant and "better" in r.interpretation)])
def test_mcnemar(spark, b, c, check):
    rows = [(1, 1, 0)] * b + [(1, 0, 1)] * c + [(1, 1, 1)] * 5
    df = spark.createDataFrame(rows, "y int, a int, b int")
    assert check(ev.mcnemar(df, F.col("y"), F.col("a"), F.col("b")).first())


def test_bootstrap_covers_estimate(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("y"), ((F.col("id") % 10) < 6).alias("p"), (F.col("id") % 7).alias("s"))
    for r in ev.bootstrap_metrics(df, F.col("y") == 1, F.col("p"), 200).collect():
        assert r.ci_lower <= r.estimate <= r.ci_upper
    for r in ev.stratified_bootstrap(df, "y", F.col("p"), "s", 200).collect():
        assert r.ci_lower <= r.estimate <= r.ci_upper
    r = ev.bootstrap_mean(df, "s", 200).first()
    assert r.ci_lower < r["mean"] < r.ci_upper and r.ci_upper - r.ci_lower < 0.3


def test_agreement_case(spark):
    preds = spark.createDataFrame([("a", "HIGH"), ("b", "CLEAN"), ("c", "CLEAN"), ("d", "HIGH")], "record_id string, label_a string")
    cons = spark.createDataFrame([("a", "HIGH"), ("b", "CLEAN"), ("c", "HIGH"), ("d", "UNKNOWN")], "record_id string, label string")
    r = ev.agreement(preds, cons).first()
    assert (r.total_records, r.comparable_records, r.agreement_count) == (4, 3, 2) and r.agreement_rate == pytest.approx(2 / 3)
    m = ev.consensus_confusion(preds, cons).first()
    assert (m.tp, m.tn, m.fn) == (1, 1, 1)


def test_ablation_variants(spark):
    df = spark.createDataFrame([(90.0, 10.0, 10.0, "HIGH"), (10.0, 80.0, 90.0, "CLEAN")], "document double, phishing double, upi double, true_label string")
    out = {r.variant: r for r in ev.signal_ablation(df).collect()}
    assert len(out) == 5
    assert out["no_document_signal"].tp == 0 and out["no_document_signal"].fp == 1


def test_hash_rank_is_exact_under_skew(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("label"))
    out = tr.stratified_split(df, "id", "label", {"train": 0.7, "val": 0.15, "test": 0.15})
    counts = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert counts[(0, "train")] == 3150 and counts[(1, "train")] == 350 and counts[(1, "test")] == 75
    folds = tr.stratified_folds(df, "id", "label").groupBy("label", "fold").count().collect()
    assert {r["count"] for r in folds} == {900, 100}


def test_smote_balances_and_stays_between_neighbours(spark):
    rows = [(f"n{i}", 0, i / 60.0, 0.0) for i in range(60)] + [(f"p{i}", 1, i / 100.0, 1.0) for i in range(10)] + [
        (f"q{i}", 1, 0.5, 1.0) for i in range(10)]  # copies
    df = spark.createDataFrame(rows, "id string, label int, x double, y double")
    out = tr.smote(df, "id", "label", ["x", "y"])
    r = {(a.label, a.synthetic): a for a in out.groupBy("label", "synthetic").agg(
        F.count("*").alias("n"), F.min("y").alias("lo"), F.max("x").alias("hi")).collect()}
    assert r[(0, False)].n == 60 and r[(1, False)].n + r[(1, True)].n == 60
    assert r[(1, True)].lo == 1.0 and r[(1, True)].hi <= 0.5


def test_nearest_points_equal_full_sort():
    rng = np.random.default_rng(8)
    for points, k in ((400, 5), (3, 5), (1, 2), (0, 3)):
        at = rng.integers(0, 4, (points, 3)).astype(float)  # many ties
        own = np.concatenate([at[:40], rng.normal(size=(30, 3))])
        selves = [*range(len(at[:40])), *[-1] * 30]
        want = []
        for x, own_index in zip(own, selves):
            gaps = sorted((((x - y) ** 2).sum(), i) for i, y in enumerate(at) if i != own_index)
            want.append([i for _, i in gaps[:k]])
        for leaf in (4, 64, 1000):
            assert tr.PointTree(at, leaf).nearest(own, k, np.array(selves)) == want


def test_smote_neighbours_are_true_ones_among_all_points(spark):
    n = 25_000  # on a line, so the five nearest are at most three steps away (five at the ends)
    df = spark.range(3 * n).select(F.col("id").cast("string").alias("id"), (F.col("id") < n).cast("int").alias("label"), F.col("id").cast("double").alias("x"))
    out = tr.smote(df, "id", "label", ["x"]).where("synthetic").withColumn("base", F.split("id", "-")[1].cast("double"))
    assert out.count() == n
    step = F.when(F.col("base").between(3, n - 4), 3).otherwise(5)
    assert out.where(F.abs(F.col("x") - F.col("base")) > step + 1e-9).count() == 0


@pytest.mark.parametrize("cell", [15, 100_000])
def test_nearest_points_over_cells_equal_full_sort(spark, cell, monkeypatch):
    monkeypatch.setattr(tr, "CELL", cell)
    rng = np.random.default_rng(4)
    at = np.unique(np.concatenate([rng.integers(0, 5, (300, 3)).astype(float), rng.normal(size=(80, 3)) / 9, [[900.0, 0, 0]]]), axis=0)
    rows = [(x.tolist(), i * 7 % 10, f"p{i:03d}", 1) for i, x in enumerate(at)]
    df = spark.createDataFrame(rows, "_x array<double>, _tie bigint, _pid string, _copies bigint")
    got = {tuple(r._x): [p.pid for p in r._found] for r in tr.nearest_points(df, 3, 4).collect()}
    assert len(got) == len(rows)
    for x, _, pid, _ in rows:
        gaps = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), tie, other) for y, tie, other, _ in rows if other != pid)
        assert got[tuple(x)] == [other for _, _, other in gaps[:4]]


def test_smote_keeps_rows_without_a_distance_apart(spark):
    rows = [(f"n{i}", 0, 0.0) for i in range(9)] + [("a", 1, 1.0), ("b", 1, 2.0), ("c", 1, None), ("d", 1, float("nan"))]
    out = tr.smote(spark.createDataFrame(rows, "id string, label int, x double"), "id", "label", ["x"]).where("synthetic").collect()
    assert len(out) == 5 and all(1 <= r.x <= 2 for r in out if r.id.split("-")[1] in "ab")
    assert all(r.x is None or np.isnan(r.x) for r in out if r.id.split("-")[1] in "cd")


@pytest.mark.parametrize("rise, n, least", [(0.2, 2000, 40), (-1.0, 800, 4096), (0.0, 0, 4096)])
def test_isotonic_blocks_equal_the_sequential_rule(spark, monkeypatch, rise, n, least):
    monkeypatch.setattr(isotonic, "RANGE", least)  # small ranges: borders must be settled
    rng = random.Random(6)
    rows = [(round(rng.random(), 3), 0) for _ in range(n)]
    rows = [(p, int(rng.random() < min(max(0.5 + rise * (p - 0.5), 0), 1))) for p, _ in rows] + [(0.5, 1)] * (n // 2)
    sums = {}
    for p, y in rows:
        a, b = sums.get(p, (0, 0))
        sums[p] = a + 1, b + y
    held = []
    for p in sorted(sums):
        block = [p, p, *sums[p]]
        while held and held[-1][3] * block[2] >= block[3] * held[-1][2]:
            last = held.pop()
            block = [last[0], block[1], last[2] + block[2], last[3] + block[3]]
        held.append(block)
    df = spark.createDataFrame(rows + [(None, 1), (0.1, None)], "p double, label int").repartition(5)
    blocks = isotonic.isotonic_blocks(df)
    assert sorted(map(list, blocks.collect())) == held
    target = spark.createDataFrame([(k / 977 - 0.01, k) for k in range(1000)] + [(None, -1)], "p double, k int")
    got = {r.k: r.calibrated for r in isotonic.isotonic_apply(target, blocks).collect()}
    ends = [(x, b[3] / b[2]) for b in held for x in b[:2]]
    want = np.interp([k / 977 - 0.01 for k in range(1000)], *zip(*ends)) if ends else [None] * 1000
    assert len(got) == 1001 and got[-1] is None and [got[k] for k in range(1000)] == (pytest.approx(list(want)) if ends else want)
