"""Classifier evaluation as aggregates.

Every statistic is computed from counts per confusion cell or per distinct score; nothing is
collected and no row-by-row comparison matrix is built.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as LB
from ..functions.exprs import clip, md5_unit, pin, safe_div
from . import fusion
from .ranking import add_ranges, quantiles, running_before

METRICS = ["accuracy", "precision", "recall", "f1", "fpr", "fnr"]


# ---- confusion metrics -------------------------------------------------------

def confusion(df: DataFrame, truth: Column, pred: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn and support per group; truth and pred are boolean columns."""
    return df.groupBy(*(by or [])).agg(
        F.count_if(truth & pred).alias("tp"), F.count_if(~truth & pred).alias("fp"),
        F.count_if(~truth & ~pred).alias("tn"), F.count_if(truth & ~pred).alias("fn"), F.count("*").alias("support"))


def metric_columns(tp="tp", fp="fp", tn="tn", fn="fn") -> dict[str, Column]:
    """Metric expressions over the four cells, 0 on empty denominators."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in (tp, fp, tn, fn))
    denom = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    precision, recall = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return {
        "accuracy": safe_div(tp + tn, tp + fp + tn + fn), "precision": precision, "recall": recall,
        "f1": safe_div(2 * precision * recall, precision + recall), "fpr": safe_div(fp, fp + tn),
        "fnr": safe_div(fn, fn + tp), "mcc": safe_div(tp * tn - fp * fn, denom),
    }


def classification_metrics(df: DataFrame, true_label: str, pred_label: str, by: list[str] | None = None) -> DataFrame:
    t, p = LB.is_positive(F.col(true_label)), LB.is_positive(F.col(pred_label))
    return confusion(df, t, p, by).withColumns(metric_columns())


def log_loss(df: DataFrame, truth: str, probability: str, by: list[str] | None = None) -> DataFrame:
    p = clip(F.col(probability), 1e-15, 1 - 1e-15)
    loss = -F.when(F.col(truth) == 1, F.log(p)).otherwise(F.log(1 - p))
    return df.groupBy(*(by or [])).agg(F.avg(loss).alias("log_loss"))


def long_metrics(df: DataFrame, by: list[str], metrics: list[str] = METRICS) -> DataFrame:
    """(by..., metric, value) rows, the form metric tables are stored in."""
    return df.unpivot(by, metrics, "metric", "value")


def latency_summary(df: DataFrame, latency: str = "latency_ms", by: list[str] | None = None) -> DataFrame:
    """Mean, exact median, p95, p99, min and max."""
    by = by or []
    q = quantiles(df, latency, {"median": 0.50, "p95": 0.95, "p99": 0.99}, by)
    base = df.groupBy(*by).agg(F.avg(latency).alias("mean"), F.min(latency).alias("min"), F.max(latency).alias("max"))
    return base.join(q, by) if by else base.crossJoin(F.broadcast(q))


# ---- rank statistics --------------------------------------------------------------

def score_counts(df: DataFrame, truth: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Positives and negatives per distinct score, with the counts below it (combined map-side)."""
    by = by or []
    hist = df.groupBy(*by, F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    return running_before(hist, by, "s", ["pos", "neg"])


def auc(df: DataFrame, truth: str, score: str, by: list[str] | None = None) -> DataFrame:
    """ROC AUC with ties as half wins; 0.5 when a class is missing."""
    by = by or []
    wins = F.sum(F.col("pos") * (F.col("before_neg") + 0.5 * F.col("neg")))
    return score_counts(df, truth, score, by).groupBy(*by).agg(
        F.coalesce(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")), F.lit(0.5)).alias("auc"))


def placements(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Placement value of each distinct score: v10 (as a positive) and v01 (as a negative)."""
    counts = score_counts(df, truth, score)
    totals = df.agg(F.count_if(F.col(truth) == 1).alias("m"), F.count_if(F.col(truth) == 0).alias("n"))
    c = counts.crossJoin(F.broadcast(totals))
    above = F.col("m") - F.col("before_pos") - F.col("pos")
    return c.select(
        "s", "pos", "neg", "m", "n",
        F.try_divide(F.col("before_neg") + 0.5 * F.col("neg"), F.col("n")).alias("v10"),
        F.try_divide(above + 0.5 * F.col("pos"), F.col("m")).alias("v01"))


def delong_ci(df: DataFrame, truth: str, score: str, alpha: float = 0.05) -> DataFrame:
    """AUC, standard error and normal interval from placement values."""
    p = placements(df, truth, score)
    s = p.agg(
        F.max("m").alias("m"), F.max("n").alias("n"),
        F.sum(F.col("pos") * F.col("v10")).alias("a1"), F.sum(F.col("pos") * F.col("v10") * F.col("v10")).alias("a2"),
        F.sum(F.col("neg") * F.col("v01")).alias("b1"), F.sum(F.col("neg") * F.col("v01") * F.col("v01")).alias("b2"))
    out = s.withColumn("auc", F.coalesce(F.try_divide("a1", "m"), F.lit(0.5)))
    var = lambda s1, s2, k: F.coalesce(F.try_divide(
        F.col(s2) - F.col(s1) * F.col(s1) / F.col(k), F.when(F.col(k) > 1, F.col(k) - 1)), F.lit(0.0))
    out = out.withColumn("se", F.sqrt(F.greatest(F.lit(0.0), F.when(
        (F.col("m") > 0) & (F.col("n") > 0), var("a1", "a2", "m") / F.col("m") + var("b1", "b2", "n") / F.col("n")).otherwise(0.0))))
    z = NormalDist().inv_cdf(1 - alpha / 2)
    return out.select(
        "auc", "se", F.greatest(F.lit(0.0), F.col("auc") - z * F.col("se")).alias("ci_lower"),
        F.least(F.lit(1.0), F.col("auc") + z * F.col("se")).alias("ci_upper"))


def delong_compare(df: DataFrame, truth: str, score_a: str, score_b: str) -> DataFrame:
    """Paired AUC comparison: auc_a, auc_b, z_statistic, p_value.

    Rows are reduced to distinct (score_a, score_b) pairs before placement values are joined on.
    """
    pairs = df.groupBy(F.col(score_a).cast("double").alias("sa"), F.col(score_b).cast("double").alias("sb")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    pa = placements(df, truth, score_a).select(F.col("s").alias("sa"), F.col("v10").alias("xa"), F.col("v01").alias("ya"), "m", "n")
    pb = placements(df, truth, score_b).select(F.col("s").alias("sb"), F.col("v10").alias("xb"), F.col("v01").alias("yb"))
    j = pairs.join(pa, "sa").join(pb, "sb")

    def moments(w: str, a: str, b: str, tag: str) -> list[Column]:
        return [F.sum(F.col(w) * F.col(a)).alias(f"{tag}_a"), F.sum(F.col(w) * F.col(b)).alias(f"{tag}_b"),
                F.sum(F.col(w) * F.pow(F.col(a) - F.col(b), F.lit(2))).alias(f"{tag}_dd")]

    s = j.agg(F.max("m").alias("m"), F.max("n").alias("n"), *moments("pos", "xa", "xb", "p"), *moments("neg", "ya", "yb", "q"))
    # var(a) + var(b) - 2 cov(a, b) is the variance of the paired difference.
    part = lambda tag, k: F.coalesce(F.try_divide(
        F.col(f"{tag}_dd") - F.pow(F.col(f"{tag}_a") - F.col(f"{tag}_b"), F.lit(2)) / F.col(k),
        F.when(F.col(k) > 1, (F.col(k) - 1) * F.col(k))), F.lit(0.0))
    out = s.withColumns({
        "auc_a": F.coalesce(F.try_divide("p_a", "m"), F.lit(0.5)), "auc_b": F.coalesce(F.try_divide("p_b", "m"), F.lit(0.5)),
        "_var": part("p", "m") + part("q", "n"),
    })
    z = F.when(F.col("_var") > 1e-18, (F.col("auc_a") - F.col("auc_b")) / F.sqrt("_var")).otherwise(0.0)
    return out.select("auc_a", "auc_b", z.alias("z_statistic")).withColumn("p_value", two_sided_p(F.col("z_statistic")))


@F.pandas_udf(T.DoubleType())
def _two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)))


def two_sided_p(z: Column) -> Column:
    """Normal tail for a handful of aggregated rows; Spark has no error function."""
    return _two_sided(z)


@F.pandas_udf(T.DoubleType())
def _mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:
    def one(x: int, y: int) -> float:
        n, k = int(x + y), int(min(x, y))
        if n == 0:
            return 1.0
        if n < 25:
            below = sum(math.comb(n, i) for i in range(k))
            return min(1.0, 2.0 * (below + 0.5 * math.comb(n, k)) / 2.0 ** n)
        return math.erfc(math.sqrt((abs(x - y) - 1.0) ** 2 / n / 2.0))
    return pd.Series([one(x, y) for x, y in zip(b, c)])


def mcnemar(df: DataFrame, truth: Column, pred_a: Column, pred_b: Column, by: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Discordant counts b, c, test statistic, p value and reading. p is computed on the aggregated rows."""
    a_ok, b_ok = pred_a == truth, pred_b == truth
    out = df.groupBy(*(by or [])).agg(F.count_if(a_ok & ~b_ok).alias("b"), F.count_if(~a_ok & b_ok).alias("c"))
    n = F.col("b") + F.col("c")
    stat = (
        F.when(n == 0, 0.0).when(n < 25, F.least("b", "c").cast("double"))
        .otherwise(F.pow(F.abs(F.col("b") - F.col("c")) - 1.0, F.lit(2)) / n)
    )
    out = out.withColumn("statistic", stat).withColumn("p_value", _mcnemar_p("b", "c"))
    sig = F.col("p_value") < alpha
    return out.withColumn("significant", sig).withColumn("interpretation", F.when(
        ~sig, "no difference shown").when(
        F.col("b") > F.col("c"), "A is better, with fewer errors").otherwise(
        "A is worse, with more errors"))


def paired_differences(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    left = a.select(key, F.col(value).alias("_a"))
    right = b.select(key, F.col(value).alias("_b"))
    return left.join(right, key).select(key, (F.col("_a") - F.col("_b")).alias("difference"))


# ---- bootstrap ----------------------------------------------------------------------

def resample_weight(count: Column, salt: str, *keys: Column | str) -> Column:
    """The weight of a group of ``count`` equal rows in one resample of the Bayesian bootstrap.

    The sum of ``count`` unit exponential weights is a gamma draw, here by the cube of one normal number from hashes
    (Wilson and Hilferty), for every count alike. Rows never have to be repeated per resample.
    """
    u1, u2 = md5_unit(salt + "/r", *keys), md5_unit(salt + "/t", *keys)
    z = F.sqrt(-2.0 * F.log(1.0 - u1)) * F.cos(2.0 * math.pi * u2)
    n = count.cast("double")
    root = F.greatest(F.lit(0.0), 1.0 - 1.0 / (9.0 * n) + z / (3.0 * F.sqrt(n)))
    return F.when(count == 0, 0.0).otherwise(n * root * root * root)


def replicates(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n))))


def bootstrap_mean(df: DataFrame, value: str, n: int = 1000, confidence: float = 0.95, salt: str = "mean") -> DataFrame:
    """Percentile interval of the mean. Work grows with distinct values times resamples."""
    hist = df.groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    w = replicates(hist, n).withColumn("w", resample_weight(F.col("n"), salt, "v", "rep"))
    reps = w.groupBy("rep").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("stat"))
    low = (1 - confidence) / 2
    ci = reps.agg(F.percentile("stat", F.lit(low)).alias("ci_lower"), F.percentile("stat", F.lit(1 - low)).alias("ci_upper"))
    return df.agg(F.avg(value).alias("mean")).crossJoin(ci)


def bootstrap_metrics(df: DataFrame, truth: Column, pred: Column, n: int = 1000, confidence: float = 0.95, salt: str = "cells") -> DataFrame:
    """Percentile intervals of accuracy, precision, recall and F1 by resampling the four cells."""
    cells = ["tp", "fp", "tn", "fn"]
    base = confusion(df, truth, pred)
    drawn = replicates(base, n).select("rep", *[
        resample_weight(F.col(c), salt, F.lit(c), "rep").alias(c) for c in cells])
    names = ["accuracy", "precision", "recall", "f1"]
    reps = drawn.withColumns(metric_columns()).unpivot(["rep"], names, "metric", "stat")
    low = (1 - confidence) / 2
    ci = reps.groupBy("metric").agg(
        F.percentile("stat", F.lit(low)).alias("ci_lower"), F.percentile("stat", F.lit(1 - low)).alias("ci_upper"))
    point = base.withColumns(metric_columns()).unpivot(["support"], names, "metric", "estimate").drop("support")
    return point.join(F.broadcast(ci), "metric")


def stratified_bootstrap(df: DataFrame, truth: str, pred: Column, score: str, n: int = 2000, confidence: float = 0.95,
                         salt: str = "strata") -> DataFrame:
    """Intervals of F1, precision, recall, AUC and MCC that keep class sizes in every resample.

    Groups are (class, decision, score); their draws are rescaled so that each class keeps its size. All resamples share
    the ranges of scores: distinct scores are dealt by (range, block of resamples) once, draws stay in their task, and
    running sums go over a range's own scores and over the sums of ranges.
    """
    hist = df.groupBy(F.col(truth).alias("y"), pred.alias("p"), F.col(score).cast("double").alias("s")).agg(F.count("*").alias("n"))
    block = 250
    blocks = F.explode(F.sequence(F.lit(0), F.lit((n - 1) // block)))
    dealt = add_ranges(hist, "s").withColumn("_block", blocks).repartition("_range", "_block")
    first = F.col("_block") * block
    drawn = dealt.withColumn("rep", F.explode(F.sequence(first + 1, F.least(first + block, F.lit(n)))))
    w = drawn.withColumn("w", resample_weight(F.col("n"), salt, "y", "p", "s", "rep"))
    pos, neg = F.col("y") == 1, F.col("y") == 0
    part = ["_range", "_block", "rep"]
    cells = ("tp", "fp", "tn", "fn")
    by_score = w.groupBy(*part, "s").agg(
        F.sum(F.when(pos & F.col("p"), F.col("w")).otherwise(0.0)).alias("tp"),
        F.sum(F.when(neg & F.col("p"), F.col("w")).otherwise(0.0)).alias("fp"),
        F.sum(F.when(neg & ~F.col("p"), F.col("w")).otherwise(0.0)).alias("tn"),
        F.sum(F.when(pos & ~F.col("p"), F.col("w")).otherwise(0.0)).alias("fn"))
    negatives, positives = F.col("fp") + F.col("tn"), F.col("tp") + F.col("fn")
    inside = Window.partitionBy(*part).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    by_score = by_score.withColumn("below", F.coalesce(F.sum(negatives).over(inside), F.lit(0.0)))
    by_range = by_score.groupBy(*part).agg(*[F.sum(c).alias(c) for c in cells], F.sum(
        positives * (F.col("below") + 0.5 * negatives)).alias("wins"))
    earlier = Window.partitionBy("rep").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    by_range = by_range.withColumn("wins", F.col("wins") + positives * F.coalesce(F.sum(negatives).over(earlier), F.lit(0.0)))
    sums = by_range.groupBy("rep").agg(*[F.sum(c).alias(c) for c in cells], F.sum("wins").alias("wins"))
    sums = sums.withColumn("auc", safe_div(F.col("wins"), positives * negatives))
    sizes = hist.agg(F.sum(F.when(pos, F.col("n"))).alias("_pos"), F.sum(F.when(neg, F.col("n"))).alias("_neg"))
    up, down = safe_div(F.col("_pos"), positives), safe_div(F.col("_neg"), negatives)
    sums = sums.crossJoin(F.broadcast(sizes)).select("rep", "auc", *[
        (F.col(c) * (up if c in ("tp", "fn") else down)).alias(c) for c in cells])
    m = metric_columns()
    sums = sums.withColumns({k: m[k] for k in ("f1", "precision", "recall", "mcc")})
    names = ["f1", "precision", "recall", "auc", "mcc"]
    long = sums.unpivot(["rep"], names, "metric", "stat")
    order = Window.partitionBy("metric").orderBy("stat")  # n rows per metric
    low = (1 - confidence) / 2
    lo, hi = (max(0, min(int(math.floor(p * n)), n - 1)) for p in (low, 1 - low))
    ranked = long.withColumn("i", F.row_number().over(order) - 1)
    ci = ranked.groupBy("metric").agg(
        F.max(F.when(F.col("i") == lo, F.col("stat"))).alias("ci_lower"),
        F.max(F.when(F.col("i") == hi, F.col("stat"))).alias("ci_upper"))
    t = F.col(truth) == 1
    point = confusion(df, t, pred).withColumns({k: m[k] for k in ("f1", "precision", "recall", "mcc")}).crossJoin(
        F.broadcast(auc(df, truth, score))).unpivot(["support"], names, "metric", "estimate").drop("support")
    return point.join(F.broadcast(ci), "metric")


# ---- agreement ---------------------------------------------------------------------------

def _matched(preds: DataFrame, consensus: DataFrame, pred: str) -> DataFrame:
    """Predictions with their consensus label (record_id, label), null when there is none."""
    c = consensus.select("record_id", F.col("label").alias("consensus_label"))
    return preds.join(c, "record_id", "left").withColumn("pred", F.col(pred))


def agreement(preds: DataFrame, consensus: DataFrame, pred: str = "label_a") -> DataFrame:
    j = _matched(preds, consensus, pred)
    known = F.coalesce(F.col("consensus_label") != "UNKNOWN", F.lit(False))
    same = known & (F.col("consensus_label") == F.col("pred"))
    risky = known & F.col("consensus_label").isin("HIGH", "SUSPICIOUS")
    out = j.agg(
        F.count("*").alias("total_records"), F.count_if(known).alias("comparable_records"), F.count_if(same).alias("agreement_count"),
        F.count_if(known & ~same).alias("disagreement_count"), F.count_if(~known).alias("unknown_count"),
        F.count_if(risky).alias("_risky"), F.count_if(risky & same).alias("_risky_same"))
    return out.withColumn("agreement_rate", safe_div(F.col("agreement_count"), F.col("comparable_records"))).withColumn(
        "high_risk_agreement_rate", safe_div(F.col("_risky_same"), F.col("_risky"))).drop("_risky", "_risky_same")


def disagreements(preds: DataFrame, consensus: DataFrame, pred: str = "label_a") -> DataFrame:
    j = _matched(preds, consensus, pred)
    return j.where((F.col("consensus_label") != "UNKNOWN") & (F.col("consensus_label") != F.col("pred"))).select(
        "record_id", F.col("pred").alias("predicted_label"), "consensus_label")


def consensus_confusion(preds: DataFrame, consensus: DataFrame, pred: str = "label_a") -> DataFrame:
    j = _matched(preds, consensus, pred).where(F.col("consensus_label") != "UNKNOWN")
    return classification_metrics(j, "consensus_label", "pred")


def resolve_majority(votes: DataFrame) -> DataFrame:
    """Most frequent known label per record; ties go to the higher risk."""
    n = votes.groupBy("record_id").agg(*[F.count_if(F.col("label") == name).alias(name) for name in ("HIGH", "SUSPICIOUS", "CLEAN")])
    most = F.greatest("HIGH", "SUSPICIOUS", "CLEAN")
    label = F.when(most == 0, "UNKNOWN").when(F.col("HIGH") == most, "HIGH").when(F.col("SUSPICIOUS") == most, "SUSPICIOUS").otherwise("CLEAN")
    return n.select("record_id", label.alias("label"))


def resolve_priority(votes: DataFrame, providers: list[str]) -> DataFrame:
    """Label of the first listed provider that knows the record."""
    rank = F.lit(len(providers))
    for i, p in reversed(list(enumerate(providers))):
        rank = F.when(F.col("provider") == p, i).otherwise(rank)
    rank = F.when(F.col("label") == "UNKNOWN", len(providers) + 1).otherwise(rank)
    return votes.groupBy("record_id").agg(F.min_by("label", F.struct(rank, "provider")).alias("label"))


def class_agreement(preds: DataFrame, consensus: DataFrame, pred: str = "label_a") -> DataFrame:
    """One row: agreement per class, coverage and Cohen's kappa, from the 3 x 3 cross table."""
    j = _matched(preds, consensus, pred)
    cross = j.groupBy("consensus_label", "pred").agg(F.count("*").alias("n"))
    known = cross.where(F.col("consensus_label").isNotNull() & (F.col("consensus_label") != "UNKNOWN"))
    cell = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    t, p = F.col("consensus_label"), F.col("pred")
    aggs = [cell(t == p).alias("same"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")]
    for c in LB.LABELS:
        aggs += [cell(t == c).alias(f"t_{c}"), cell(p == c).alias(f"p_{c}"), cell((t == c) & (p == c)).alias(f"s_{c}")]
    s = known.agg(*aggs)
    total = cross.agg(F.sum("n").alias("total"))
    po = safe_div(F.col("same"), F.col("n"))
    pe = safe_div(sum(F.col(f"t_{c}").cast("double") * F.col(f"p_{c}") for c in LB.LABELS), F.col("n").cast("double") * F.col("n"))
    return s.crossJoin(F.broadcast(total)).select(
        po.alias("overall_agreement_rate"),
        *[safe_div(F.col(f"s_{c}"), F.col(f"t_{c}")).alias(f"{c.lower()}_agreement_rate") for c in LB.LABELS],
        safe_div(F.col("n"), F.col("total")).alias("consensus_coverage"),
        F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(0.0)).alias("cohen_kappa"))


# ---- errors ---------------------------------------------------------------------------------

def error_cases(preds: DataFrame, records: DataFrame, pred: str = "label_a", score: str = "score_a") -> DataFrame:
    """Wrong predictions with error type and taxonomy category.

    preds: record_id, label, score, error, explanation, flag_count; records: record_id, true_label.
    """
    j = preds.join(records.select("record_id", "true_label"), "record_id")
    t, p = LB.is_positive(F.col("true_label")), LB.is_positive(F.col(pred))
    kind = F.when(t, "FALSE_NEGATIVE").otherwise("FALSE_POSITIVE")
    cat = (
        F.when(F.coalesce("error", F.lit("")) != "", "API_ERROR")
        .when(F.lower(F.coalesce("explanation", F.lit(""))).contains("no active signals"), "NO_ACTIVE_SIGNALS")
        .when(~t & (F.col(score) > 0) & (F.col(score) < 50), "OVER_SENSITIVE")
        .when(t & (F.coalesce("flag_count", F.lit(0)) > 0), "CORRELATION_MISS")
        .otherwise("FORENSICS_FAILURE")
    )
    return j.where(t != p).select(
        "record_id", "true_label", F.col(pred).alias("predicted_label"), F.col(score).alias("predicted_score"),
        kind.alias("error_type"), cat.alias("category"))


def error_rollup(cases: DataFrame) -> DataFrame:
    """Counts and share by type and by category in one pass: (dimension, value, n, share_pct)."""
    dims = F.array(
        F.struct(F.lit("error_type").alias("dimension"), F.col("error_type").alias("value")),
        F.struct(F.lit("category").alias("dimension"), F.col("category").alias("value")))
    counts = cases.select(F.inline(dims)).groupBy("dimension", "value").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("dimension")) * 100.0  # a handful of rows
    return counts.withColumn("share_pct", share)


def error_samples(cases: DataFrame, keep: int = 5) -> DataFrame:
    return cases.orderBy("record_id").limit(keep)


# ---- ablation, robustness, roll-ups ----------------------------------------------------------

# The default variants; None disables a signal, numbers override its weight.
VARIANTS = {
    "full": {}, "no_document_signal": {"document": None}, "no_phishing_signal": {"phishing": None},
    "no_upi_signal": {"upi": None}, "equal_weights": {"document": 0.3333, "phishing": 0.3333, "upi": 0.3334},
}


def signal_ablation(df: DataFrame, truth: str = "true_label", variants: dict = VARIANTS) -> DataFrame:
    """Metrics of the fused score per variant. Each row is rescored in place, once per variant."""
    def arm(name: str, change: dict) -> Column:
        scores = [F.when(F.lit(change.get(m, 0) is not None), F.col(m)).alias(m) for m in fusion.WEIGHTS]
        ws = [F.lit(float(change.get(m) or fusion.WEIGHTS[m])).alias(f"_w_{m}") for m in fusion.WEIGHTS]
        return F.struct(F.lit(name).alias("variant"), *scores, *ws)

    rows = df.select(truth, F.inline(F.array(*[arm(k, v) for k, v in variants.items()])))
    scored = fusion.fuse(rows, {m: F.col(f"_w_{m}") for m in fusion.WEIGHTS})
    label = F.when(F.col("unified_score") < 30, "CLEAN").when(F.col("unified_score") < 60, "SUSPICIOUS").otherwise("HIGH")
    return classification_metrics(scored.withColumn("pred", label), truth, "pred", ["variant"])


def best_variant(metrics: DataFrame) -> DataFrame:
    """Highest (F1, accuracy); remaining ties go to the first name."""
    return metrics.orderBy(F.desc("f1"), F.desc("accuracy"), "variant").limit(1)


def sliced_metrics(df: DataFrame, truth: str, pred: Column, score: str, dims: dict[str, list[str]]) -> DataFrame:
    """Metrics and AUC overall and per slice; slices without rows get the default row.

    One pass builds counts per (dimension, slice, score); everything else works on those.
    """
    slices = [F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("slice"))] + [
        F.struct(F.lit(d).alias("dimension"), F.col(d).alias("slice")) for d in dims]
    rows = df.select(F.col(truth).alias("y"), pred.alias("p"), F.col(score).alias("s"), F.inline(F.array(*slices)))
    by = ["dimension", "slice"]
    m = confusion(rows, F.col("y") == 1, F.col("p"), by).withColumns(metric_columns())
    a = auc(rows, "y", "s", by)
    have = m.join(a, by).select(*by, "support", "precision", "recall", "f1", "auc", "mcc")
    wanted = [("overall", "all")] + [(d, v) for d, vs in dims.items() for v in vs]
    want = df.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("slice")) for d, v in wanted])))
    out = want.join(have, by, "left")
    zero = {"support": F.lit(0), "precision": F.lit(0.0), "recall": F.lit(0.0), "f1": F.lit(0.0), "auc": F.lit(0.5), "mcc": F.lit(0.0)}
    return out.select(*by, *[F.coalesce(c, z).alias(c) for c, z in zero.items()])


def fold_comparison(df: DataFrame, truth: str, models: dict[str, Column], fold: str) -> DataFrame:
    """Mean and population deviation of each metric over folds: (model, metric, mean, std)."""
    arms = F.array(*[F.struct(F.lit(n).alias("model"), c.alias("p")) for n, c in models.items()])
    rows = df.select(F.col(truth).alias("y"), fold, F.inline(arms))
    per = confusion(rows, F.col("y") == 1, F.col("p"), ["model", fold]).withColumns(metric_columns())
    long = per.unpivot(["model", fold], ["accuracy", "precision", "recall", "f1", "mcc"], "metric", "value")
    return long.groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def scenario_robustness(df: DataFrame, key: str, truth: str, scenarios: dict[str, dict[str, Column]], model) -> DataFrame:
    """F1 of ``model`` (columns -> boolean) under column rewrites; scenario rows are made in place."""
    cols = sorted({c for change in scenarios.values() for c in change} | set(model.columns))
    arms = F.array(*[
        F.struct(F.lit(name).alias("scenario"), *[change.get(c, F.col(c)).cast("double").alias(c) for c in cols])
        for name, change in scenarios.items()])
    rows = df.select(F.col(truth).alias("_y"), F.inline(arms))
    return confusion(rows, F.col("_y") == 1, model.decide(), ["scenario"]).withColumns(metric_columns())


class LinearRule:
    """A fixed linear decision: intercept + sum(weight * column) > 0."""

    def __init__(self, intercept: float, weights: dict[str, float]):
        self.intercept, self.weights, self.columns = intercept, weights, list(weights)

    def margin(self) -> Column:
        return sum((F.lit(w) * F.col(c) for c, w in self.weights.items()), F.lit(self.intercept))

    def decide(self) -> Column:
        return F.round(self.margin(), 9) > 0


def sign_step(df: DataFrame, truth: str, rule: LinearRule, epsilons: list[float], columns: list[str]) -> DataFrame:
    """Perturbed copies of each row per epsilon along the evading sign, clipped to valid ranges.

    Deviation, minimum and maximum are one aggregated row, broadcast. Columns that hold only 0 and
    1 stay fixed.
    """
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (
        ("sd", F.stddev_pop), ("lo", F.min), ("hi", F.max))], *[
        F.min(F.col(c).isin(0.0, 1.0)).alias(f"_bin_{c}") for c in columns])
    rows = df.crossJoin(F.broadcast(stats)).withColumn("eps", F.explode(F.array(*[F.lit(float(e)) for e in epsilons])))
    moved = {}
    for c in columns:
        toward = -1.0 if rule.weights.get(c, 0.0) > 0 else (1.0 if rule.weights.get(c, 0.0) < 0 else 0.0)
        sd = F.when(F.col(f"_sd_{c}") > 0, F.col(f"_sd_{c}")).otherwise(1.0)
        step = F.when(F.col(truth) == 1, toward).otherwise(-toward) * F.col("eps") * sd
        x = F.col(c) + step
        x = F.when(F.col(f"_lo_{c}") >= 0, F.greatest(x, F.lit(0.0))).otherwise(x)
        x = F.when(F.col(f"_hi_{c}") <= 1, F.least(x, F.lit(1.0))).otherwise(x)
        moved[c] = F.when(F.col(f"_bin_{c}"), F.col(c)).otherwise(x)
    out = rows.withColumn("pred_before", rule.decide())
    out = out.select(*df.columns, "eps", "pred_before", *[v.alias(f"_new_{k}") for k, v in moved.items()])
    return out.select(*[c for c in df.columns if c not in moved], "eps", "pred_before",
                      *[F.col(f"_new_{c}").alias(c) for c in moved])


def attack_success(df: DataFrame, truth: str, before: Column, after: Column, by: str = "eps") -> DataFrame:
    """Share of caught fraud that a perturbation turns into a miss."""
    caught = (F.col(truth) == 1) & before
    return df.groupBy(by).agg(F.count_if(caught).alias("caught"), F.count_if(caught & ~after).alias("flipped")).withColumn(
        "asr", safe_div(F.col("flipped"), F.col("caught")))


def robustness(asr: DataFrame) -> DataFrame:
    out = asr.agg((1 - F.avg("asr")).alias("robustness"))
    return out.withColumn("verdict", F.when(F.col("robustness") >= 0.8, "ROBUST").when(
        F.col("robustness") >= 0.55, "MODERATE").otherwise("VULNERABLE"))


def experiment_rollup(preds: DataFrame, consensus: DataFrame, by: str = "module") -> DataFrame:
    """One row per module: metrics, exact latency quantiles, agreement, errors. Inputs are scanned, never collected."""
    m = classification_metrics(preds, "true_label", "label_a", [by])
    lat = latency_summary(preds, "latency_ms", [by])
    j = _matched(preds, consensus, "label_a")
    known = F.coalesce(F.col("consensus_label") != "UNKNOWN", F.lit(False))
    wrong = LB.is_positive(F.col("true_label")) != LB.is_positive(F.col("label_a"))
    rest = j.groupBy(by).agg(
        safe_div(F.count_if(known & (F.col("consensus_label") == F.col("label_a"))), F.count_if(known)).alias("agreement_rate"),
        F.count_if(wrong).alias("errors"))
    return m.join(lat, by).join(rest, by)


def baseline_run(df: DataFrame, truth: Column, baselines: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Metrics of several baselines over the same records in one pass."""
    arms = F.array(*[
        F.struct(F.lit(n).alias("model"), s.cast("double").alias("score"), lab.alias("label")) for n, (s, lab) in baselines.items()])
    rows = pin(df, {"_y": truth}).select("_y", F.inline(arms))
    return confusion(rows, F.col("_y"), LB.is_positive(F.col("label")), ["model"]).withColumns(metric_columns())
