"""Fusion of document, phishing and payment scores, with contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import levels as L
from ..functions.exprs import clip, contains_any, finite, hit, hits, pin

# Default weights per modality.
WEIGHTS = {"document": 0.35, "phishing": 0.35, "upi": 0.30}
SCORE_KEYS = ["risk_score", "forgery_score", "score", "unified_score"]


def extract_score(json: Column) -> Column:
    """First usable score of a JSON result, clipped to 0..100; null when there is none."""
    return clip_or_null(F.coalesce(*[F.get_json_object(json, f"$.{k}").try_cast("double") for k in SCORE_KEYS]))


def clip_or_null(score: Column) -> Column:
    return F.when(score.isNotNull(), clip(score, 0.0, 100.0))


def weights(active: dict[str, Column], source: dict[str, float | Column] | None = None) -> dict[str, Column]:
    """Weights renormalised over the present modalities; equal shares when they sum to 0."""
    raw = {**WEIGHTS, **(source or {})}
    w = {m: F.when(active[m], raw[m] if isinstance(raw[m], Column) else F.lit(float(raw[m]))).otherwise(0.0) for m in WEIGHTS}
    total = w["document"] + w["phishing"] + w["upi"]
    n = sum(F.when(active[m], 1).otherwise(0) for m in WEIGHTS)
    return {m: F.when(total == 0, F.when(active[m], 1.0 / n).otherwise(0.0)).otherwise(w[m] / total) for m in WEIGHTS}


def align(document: DataFrame, phishing: DataFrame, upi: DataFrame, key: str = "case_id") -> DataFrame:
    """Full outer join of three score tables (key, score) on the case key."""
    d = document.select(key, F.col("score").alias("document"))
    p = phishing.select(key, F.col("score").alias("phishing"))
    u = upi.select(key, F.col("score").alias("upi"))
    return d.join(p, key, "full").join(u, key, "full")


def fuse(df: DataFrame, source: dict[str, float | Column] | None = None) -> DataFrame:
    """Append weights, unified_score, risk_level and dominant_signal to document/phishing/upi scores."""
    out = pin(df, {m: clip_or_null(F.col(m).cast("double")) for m in WEIGHTS})
    w = weights({m: F.col(m).isNotNull() for m in WEIGHTS}, source)
    out = pin(out, {f"{m}_weight": c for m, c in w.items()})
    total = sum(F.coalesce(F.col(m), F.lit(0.0)) * F.col(f"{m}_weight") for m in WEIGHTS)
    # The 1e-9 rounding removes summation noise before half-even rounding to an integer.
    out = pin(out, {"unified_score": F.bround(F.round(clip(total, 0.0, 100.0), 9)).cast("int")})
    s = {m: F.coalesce(F.col(m), F.lit(0.0)) for m in WEIGHTS}
    top = F.greatest(*s.values())
    dominant = F.when(top > 0, F.when(s["document"] == top, "document").when(s["phishing"] == top, "phishing").otherwise("upi"))
    return out.withColumn("risk_level", L.fusion_level(F.col("unified_score"))).withColumn("dominant_signal", dominant)


def correlation_flags(df: DataFrame) -> DataFrame:
    """Append flags that need more than one modality.

    Optional inputs: doc_rules (array of rule names), doc_text, has_campaign.
    """
    s = {m: F.coalesce(F.col(m), F.lit(-1.0)) for m in WEIGHTS}
    strong = sum(F.when(c >= 70, 1).otherwise(0) for c in s.values())
    mentions = contains_any(F.lower(F.coalesce("doc_text", F.lit(""))), ["http", "url", "phish"]) | F.exists(
        F.coalesce("doc_rules", F.array().cast("array<string>")),
        lambda r: contains_any(F.lower(r), ["url", "phish", "link", "domain"]))
    return df.withColumn("correlation_flags", hits(
        hit(strong >= 2, "shared_high_risk", 0, "critical"),
        hit(mentions & (s["phishing"] >= 50), "doc_url_alignment", 0, "warning"),
        hit((s["upi"] >= 50) & (s["phishing"] >= 50), "payment_fraud_alignment", 0, "critical"),
        hit(F.coalesce("has_campaign", F.lit(False)), "campaign_escalation", 0, "warning")))


def clean_name(name: Column) -> Column:
    return F.initcap(F.trim(F.translate(name, "_-", "  ")))


def indicator_contributions(df: DataFrame, key: str, indicators: str = "indicators") -> DataFrame:
    """Rows (key, name, raw_score, contribution_pct, direction, rank) from an indicator array.

    The share is taken over the row's own array, so nothing is shuffled.
    """
    total = F.aggregate(indicators, F.lit(0.0), lambda a, h: a + F.abs(h["score"]))
    share = lambda h: F.when(total == 0, 0.0).otherwise(F.bround(F.abs(h["score"]) / total * 100.0, 2))
    ranked = F.array_sort(F.transform(indicators, lambda h, i: F.struct(
        (-share(h)).alias("neg"), i.alias("pos"), h["rule"].alias("rule"), h["score"].cast("double").alias("raw_score"))))
    rows = df.select(key, F.posexplode(ranked).alias("i", "c"))
    return rows.select(
        key, clean_name(F.col("c.rule")).alias("name"), F.col("c.raw_score").alias("raw_score"),
        (-F.col("c.neg") + 0.0).alias("contribution_pct"), direction(F.col("c.raw_score")).alias("direction"),
        (F.col("i") + 1).alias("rank"))


def direction(raw: Column) -> Column:
    return F.when(raw > 0, "risk_increasing").when(raw < 0, "risk_decreasing").otherwise("neutral")


def feature_contributions(df: DataFrame, key: str, features: dict[str, str], weights_: dict[str, float] | None = None) -> DataFrame:
    """Contributions of raw feature columns. ``features`` maps column to kind: bool, number or level."""
    weights_ = weights_ or {}

    def raw(c: str, kind: str) -> Column:
        w = float(weights_.get(c, 1.0))
        if kind == "bool":
            return F.when(F.col(c), 40.0 * w).otherwise(0.0)
        if kind == "number":
            return finite(F.col(c)) * w
        up = F.upper(F.col(c))
        return F.when(up.isin("HIGH", "CRITICAL", "SUSPICIOUS", "FRAUD"), 50.0 * w).when(
            up.isin("CLEAN", "LOW", "SAFE"), -20.0 * w).otherwise(0.0)

    items = F.array(*[
        F.struct(F.lit(c).alias("rule"), raw(c, kind).alias("score")) for c, kind in features.items()])
    return indicator_contributions(pin(df.select(key, *features), {"_items": items}), key, "_items")


def linear_contributions(df: DataFrame, key: str, coefficients: dict[str, float], means: DataFrame | None = None) -> DataFrame:
    """Long rows (key, feature, value, contribution) with contribution = coef * (value - mean).

    The means are one aggregated row and are broadcast.
    """
    mean_row = means or df.agg(*[F.avg(c).alias(c) for c in coefficients])
    mean_row = mean_row.select(*[F.col(c).alias(f"_mean_{c}") for c in coefficients])
    rows = df.select(key, *coefficients).crossJoin(F.broadcast(mean_row))
    return rows.select(key, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                 (F.lit(float(w)) * (F.col(c) - F.col(f"_mean_{c}"))).alias("contribution"))
        for c, w in coefficients.items()])))


def global_importance(contributions: DataFrame, keep: int = 10) -> DataFrame:
    """Mean absolute contribution per feature, sign of its correlation with the value, rank."""
    stats = contributions.groupBy("feature").agg(
        F.bround(F.avg(F.abs("contribution")), 5).alias("mean_abs"),
        F.corr("value", "contribution").alias("_corr"))
    sign = F.when(F.coalesce(F.nanvl("_corr", F.lit(0.0)), F.lit(0.0)) >= 0, "positive").otherwise("negative")
    # One row per feature: the un-keyed window is over the feature list, not the data.
    order = Window.orderBy(F.desc("mean_abs"), "feature")
    return stats.select("feature", "mean_abs", sign.alias("direction"), F.row_number().over(order).alias("rank")).where(
        F.col("rank") <= keep)
