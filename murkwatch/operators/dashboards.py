"""Dashboards over the event table: counts, top-k, timelines, feeds and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import levels as L
from ..functions.exprs import lit_array


def event_arrays(df: DataFrame) -> DataFrame:
    """Turn the pipe-separated indicator and keyword lists of an event table into arrays."""
    def split(c: str) -> Column:
        return F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\|"), lambda x: x != "")
    return df.withColumn("risk_indicators", split("indicator_list")).withColumn("top_keywords", split("keyword_list"))


def slim_events(events: DataFrame) -> DataFrame:
    """The projection campaigns and graphs show, with its display label."""
    return events.select(
        "event_id", "doc_id", F.coalesce("source_type", F.lit("DOCUMENT")).alias("source_type"),
        F.coalesce("original_filename", "source_domain", "event_id", F.lit("unknown")).alias("label"),
        F.coalesce("risk_score", F.lit(0)).alias("risk_score"), F.coalesce("risk_level", F.lit("CLEAN")).alias("risk_level"),
        "created_at")


def indicator_frequency(events: DataFrame, keep: int = 20) -> DataFrame:
    """Top indicators by count, ties by name."""
    counts = events.select(F.explode("risk_indicators").alias("indicator")).groupBy("indicator").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "indicator").limit(keep)


def store_statistics(events: DataFrame) -> DataFrame:
    """One row of totals by source and level, in one pass with map-side partial aggregates."""
    level = L.dashboard_level(F.col("risk_level"))
    return events.agg(
        F.count("*").alias("total_events"),
        F.count_if(F.col("source_type") == "DOCUMENT").alias("document_events"),
        F.count_if(F.col("source_type") == "URL").alias("url_events"),
        F.count_if(level == "CLEAN").alias("clean_count"),
        F.count_if(level == "SUSPICIOUS").alias("suspicious_count"),
        F.count_if(level == "HIGH").alias("high_risk_count"),
        F.count_if(level == "CRITICAL").alias("critical_count"),
        F.coalesce(F.bround(F.sum("risk_score") / F.count("*"), 2), F.lit(0.0)).alias("average_risk_score"))


def recent_events(events: DataFrame, limit: int = 20, key: str = "event_id") -> DataFrame:
    """Latest events; sort and limit run as one top-k, never a full sort."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return events.orderBy(F.desc("created_at"), F.desc(key)).limit(limit)


def risk_distribution(events: DataFrame) -> DataFrame:
    """Count per dashboard level, all four levels present even when 0."""
    dim = events.sparkSession.range(1).select(F.explode(lit_array(L.DASHBOARD_LEVELS)).alias("risk_level"))
    counts = events.groupBy(L.dashboard_level(F.col("risk_level")).alias("risk_level")).agg(F.count("*").alias("n"))
    # Both sides have at most four rows.
    return dim.join(F.broadcast(counts), "risk_level", "left").select("risk_level", F.coalesce("n", F.lit(0)).alias("n"))


def timeline(events: DataFrame, end: Column, days: int = 7) -> DataFrame:
    """Events per day and source over the last ``days`` days, zero-filled.

    Only the day range is read (pushed to the scan as a timestamp filter); the calendar side has
    ``days`` rows and is joined against at most ``days`` aggregated rows.
    """
    start = F.date_sub(end, days - 1)
    calendar = events.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("day"))
    in_range = events.where((F.col("created_at") >= start) & (F.col("created_at") < F.date_add(end, 1)))
    counts = in_range.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count_if(F.col("source_type") == "URL").alias("phishing"),
        F.count_if(F.col("source_type") == "DOCUMENT").alias("documents"))
    out = calendar.join(F.broadcast(counts), "day", "left")
    phishing, documents = F.coalesce("phishing", F.lit(0)), F.coalesce("documents", F.lit(0))
    return out.select(
        "day", phishing.alias("phishing"), documents.alias("documents"), (phishing + documents).alias("total"))


def parse_created_at(df: DataFrame, column: str = "created_at") -> DataFrame:
    """ISO text to timestamp; bad values become null and fall out of every timeline."""
    return df.withColumn(column, F.try_to_timestamp(F.col(column)))


def session_counters(threats: DataFrame) -> DataFrame:
    return threats.agg(
        F.count("*").alias("total"), F.count_if(F.col("threat_level").isin("CRITICAL", "HIGH")).alias("urgent"))


def threat_summary(events: DataFrame) -> DataFrame:
    """Totals with the overall threat level; an empty store yields NONE."""
    high, susp = F.col("risk_level") == "HIGH", F.col("risk_level") == "SUSPICIOUS"
    out = events.agg(
        F.count("*").alias("total_events"), F.count_if(high).alias("high_risk_count"),
        F.count_if(susp).alias("suspicious_count"))
    return out.withColumn("threat_level", L.summary_level(
        F.col("total_events"), F.col("high_risk_count"), F.col("suspicious_count")))


def replay_feed(alerts: DataFrame, receipt_events: DataFrame, keep: int = 50) -> DataFrame:
    """Last alerts and receipt events merged into one feed. Each side is a top-k before the union."""
    a = alerts.orderBy(F.desc("ts"), F.desc("id")).limit(keep)
    net = F.col("indicator_type").isin("domain", "ip")
    a = a.select(
        F.concat(F.lit("alert-"), F.col("id").cast("string")).alias("event_id"), "ts",
        F.when(net, "phish").otherwise("upi").alias("module"),
        F.coalesce(F.upper("severity"), F.lit("MEDIUM")).alias("threat_level"),
        F.coalesce("description", F.concat(F.lit("Alert on "), F.col("value"))).alias("summary"),
        F.when(F.col("severity") == "critical", 85).when(F.col("severity") == "high", 65).otherwise(45).alias("risk_score"),
        F.when(net, "PHISHING").otherwise("FRAUD").alias("ai_verdict"), F.col("indicator_type").alias("indicator"))
    r = receipt_events.orderBy(F.desc("timestamp"), F.desc("id")).limit(keep)
    r = r.select(
        F.concat(F.lit("upi-"), F.col("id").cast("string")).alias("event_id"), F.col("timestamp").alias("ts"),
        F.lit("upi").alias("module"), F.coalesce(F.upper("risk_level"), F.lit("MEDIUM")).alias("threat_level"),
        F.lit("Receipt check").alias("summary"),
        F.when(F.coalesce("risk_score", F.lit(0)) == 0, 50).otherwise(F.col("risk_score")).alias("risk_score"),
        F.when(F.col("risk_level").isin("HIGH", "CRITICAL"), "FRAUD").otherwise("CLEAN").alias("ai_verdict"),
        F.when(F.col("font_anomalies_detected") == 1, "font_anomaly").otherwise("utr_check").alias("indicator"))
    return a.unionByName(r).orderBy(F.desc("ts"), F.desc("event_id")).limit(keep)


def marginal_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Counts of every value of every column in one pass: (dimension, value, n).

    Grouping sets expand each row once per column; partial aggregation runs before the shuffle.
    """
    pairs = F.array(*[
        F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("value"))
        for c in columns])
    return df.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def class_separation(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Per-feature class means and deviations with Cohen's d (genuine 0, forged 1)."""
    long = df.select(label, F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])))
    g, f = F.when(F.col(label) == 0, F.col("x")), F.when(F.col(label) == 1, F.col("x"))
    stats = long.groupBy("feature").agg(
        F.avg(g).alias("genuine_mean"), F.stddev_samp(g).alias("genuine_std"), F.avg(f).alias("forged_mean"),
        F.stddev_samp(f).alias("forged_std"))
    pooled = F.sqrt(0.5 * (F.pow("genuine_std", F.lit(2)) + F.pow("forged_std", F.lit(2))))
    d = F.coalesce(F.try_divide(F.col("forged_mean") - F.col("genuine_mean"), pooled), F.lit(0.0))
    return stats.withColumn("separation", d)


def filter_alerts(alerts: DataFrame, severity: str | None = None, indicator_type: str | None = None) -> DataFrame:
    """Alerts by optional severity and type, newest first. Filters reach the scan."""
    if severity:
        alerts = alerts.where(F.col("severity") == severity)
    if indicator_type:
        alerts = alerts.where(F.col("indicator_type") == indicator_type)
    return alerts.orderBy(F.desc("ts"), "id")


def search_events(events: DataFrame, text: str = "", source: str | None = None, level: str | None = None) -> DataFrame:
    name = F.lower(F.coalesce("original_filename", "source_domain", F.lit("")))
    cond = name.contains(text.lower())
    if source:
        cond = cond & (F.col("source_type") == source)
    if level:
        cond = cond & (F.col("risk_level") == level)
    return events.where(cond)


def search_cases_and_alerts(cases: DataFrame, alerts: DataFrame, text: str, keep: int = 5) -> DataFrame:
    """Case-insensitive substring search over both tables, ``keep`` rows of each, lowest id first."""
    pattern = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    like = lambda c: F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    c = cases.where(like("title") | like("description") | like("notes")).orderBy("id").limit(keep)
    a = alerts.where(like("value") | like("description")).orderBy("id").limit(keep)
    c = c.select(F.lit("Case").alias("kind"), "id", "title", "status", "severity")
    a = a.select(F.lit("ThreatAlert").alias("kind"), "id", "indicator_type", "value", "severity", "description")
    return c.unionByName(a, allowMissingColumns=True)
