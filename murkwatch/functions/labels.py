"""Label vocabularies. Each source has its own map; unknown labels are handled as the source demands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import contains_any

LABELS = ["CLEAN", "SUSPICIOUS", "HIGH"]


def strict_label(raw: Column) -> Column:
    """Known labels and synonyms; null rejects the row."""
    s = F.upper(F.trim(raw))
    return (
        F.when(s.isin("CLEAN", "SUSPICIOUS", "HIGH"), s)
        .when(s.isin("BENIGN", "SAFE", "OK", "0"), "CLEAN")
        .when(s.isin("MALICIOUS", "FRAUD", "BAD", "1", "FRAUDULENT"), "HIGH")
        .when(s.isin("WARN", "WARNING", "MEDIUM"), "SUSPICIOUS")
    )


def binary_label(raw: Column) -> Column:
    s = F.lower(F.trim(raw))
    return (
        F.when(s.isin("legitimate", "clean", "benign", "safe", "ok", "0", "false", "no"), "CLEAN")
        .when(s.isin("phishing", "malicious", "forged", "fraud", "bad", "1", "true", "yes", "high"), "HIGH")
        .otherwise("SUSPICIOUS")
    )


def risk_label(raw: Column) -> Column:
    s = F.lower(F.trim(raw))
    return (
        F.when(s.isin("clean", "benign", "safe", "ok", "0", "low"), "CLEAN")
        .when(s.isin("high", "malicious", "forged", "fraud", "bad", "1", "critical"), "HIGH")
        .otherwise("SUSPICIOUS")
    )


def url_list_label(raw: Column) -> Column:
    """Three-way map of the generic URL list adapter, binary map as fallback."""
    s = F.lower(F.trim(raw))
    return F.when(s.isin("suspicious", "warn", "warning"), "SUSPICIOUS").otherwise(binary_label(raw))


def consensus_label(raw: Column) -> Column:
    """Exact names first, then substrings, else UNKNOWN."""
    s = F.lower(F.trim(raw))
    return (
        F.when(s.isNull() | s.isin("", "unknown", "missing", "none", "null"), "UNKNOWN")
        .when(s.isin("malicious", "phishing", "high", "true", "1", "1.0", "likely_forged"), "HIGH")
        .when(s.isin("suspicious", "warning", "unsafe", "unknown_risk"), "SUSPICIOUS")
        .when(s.isin("benign", "clean", "safe", "false", "0", "0.0", "genuine"), "CLEAN")
        .when(contains_any(s, ["phish", "malicious", "high", "forge"]), "HIGH")
        .when(contains_any(s, ["suspect", "suspicious", "warn"]), "SUSPICIOUS")
        .when(contains_any(s, ["clean", "benign", "safe", "genuine"]), "CLEAN")
        .otherwise("UNKNOWN")
    )


def is_positive(label: Column) -> Column:
    return F.coalesce(F.upper(label.cast("string")).isin("1", "TRUE", "HIGH", "SUSPICIOUS", "FRAUD", "YES"), F.lit(False))


def anonymize(text: Column) -> Column:
    """All redactions in their fixed order as one expression; '' for null."""
    from .privacy import REDACTIONS
    return reduce(lambda t, f: f(t), REDACTIONS, F.coalesce(text, F.lit("")))
