"""The score-to-level scales. They differ on purpose; do not merge them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level names shown by dashboards, in display order.
DASHBOARD_LEVELS = ["CLEAN", "SUSPICIOUS", "HIGH", "CRITICAL"]


def signal_level(score: Column) -> Column:
    """URL and document scores: up to 30 clean, up to 60 suspicious, else high."""
    return F.when(score <= 30, "CLEAN").when(score <= 60, "SUSPICIOUS").otherwise("HIGH")


def fusion_level(score: Column) -> Column:
    return (
        F.when(score < 25, "CLEAN").when(score < 50, "LOW").when(score < 70, "SUSPICIOUS")
        .when(score < 90, "HIGH").otherwise("CRITICAL")
    )


def receipt_verdict(score: Column) -> Column:
    return F.when(score >= 60, "LIKELY_FORGED").when(score >= 30, "SUSPICIOUS").otherwise("GENUINE")


def adapter_level(score: Column) -> Column:
    return F.when(score < 30, "CLEAN").when(score < 60, "SUSPICIOUS").otherwise("HIGH")


def adapter_label(label: Column, score: Column) -> Column:
    """Three-way label from any module's own label, falling back to the score."""
    return (
        F.when(label.isin("CLEAN", "SUSPICIOUS", "HIGH"), label)
        .when(label.isin("LIKELY_FORGED", "CRITICAL"), "HIGH")
        .when(label.isin("GENUINE", "LOW"), "CLEAN")
        .otherwise(adapter_level(score))
    )


def threat_level(label: Column, score: Column) -> Column:
    """Feed level: known names are normalised, anything else goes by score."""
    name = F.upper(label)
    by_score = (
        F.when(score >= 81, "CRITICAL").when(score >= 61, "HIGH").when(score >= 31, "MEDIUM").otherwise("LOW")
    )
    return (
        F.when(name.isin("CLEAN", "LOW_RISK", "LOW"), "LOW")
        .when(name.isin("SUSPICIOUS", "MEDIUM_RISK", "MEDIUM"), "MEDIUM")
        .when(name.isin("HIGH_RISK", "HIGH"), "HIGH")
        .when(name.isin("CRITICAL", "CRITICAL_RISK"), "CRITICAL")
        .otherwise(by_score)
    )


def utr_level(score: Column) -> Column:
    return F.when(score < 30, "CLEAN").when(score > 70, "HIGH").otherwise("SUSPICIOUS")


def dashboard_level(label: Column) -> Column:
    return F.when(label.isin("CRITICAL", "HIGH", "SUSPICIOUS"), label).otherwise("CLEAN")


def summary_level(total: Column, high: Column, suspicious: Column) -> Column:
    return (
        F.when(total == 0, "NONE")
        .when(high / total > 0.4, "CRITICAL")
        .when((high + suspicious) / total > 0.5, "ELEVATED")
        .otherwise("NORMAL")
    )


def url_action(score: Column) -> Column:
    return F.when(score > 60, "Block").when(score > 30, "Review").otherwise("Allow")


def url_action_confidence(score: Column) -> Column:
    return F.when((score > 30) & (score <= 60), "MEDIUM").otherwise("HIGH")
