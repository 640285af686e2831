"""Threat feed: the same column logic for batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import levels as L
from ..functions import labels as LB
from ..session import cut_lineage


def threat_events(df: DataFrame) -> DataFrame:
    """Detections to feed events. Stateless, so it runs unchanged on a stream.

    Input: event_id, ts, module, risk_score, risk_level, ai_score, ai_level, ai_verdict,
    triggered_rules, indicators, risk_indicators (arrays or null), subject, drift_status.
    """
    has_ai = F.col("ai_score").isNotNull()
    score = F.when(has_ai, F.col("ai_score")).otherwise(F.coalesce("risk_score", F.lit(50)))
    level = F.when(has_ai, F.coalesce("ai_level", "risk_level", F.lit("MEDIUM"))).otherwise(
        F.coalesce("risk_level", F.lit("MEDIUM")))
    first = F.coalesce("triggered_rules", "indicators", "risk_indicators", F.array().cast("array<string>"))
    module = F.col("module")
    default_verdict = (
        F.when(module == "phish", "PHISHING").when(module == "doc", "TAMPERED")
        .when(module.isin("upi", "fraud_dna"), "FRAUD").otherwise("UNKNOWN"))
    summary = (
        F.when(module == "phish", F.concat(
            F.lit("Bait link for "), F.coalesce("subject", F.lit("an unnamed host"))))
        .when(module == "doc", F.concat(
            F.lit("Altered metadata: "), F.coalesce("subject", F.lit("unnamed file"))))
        .when(module == "upi", F.concat(
            F.lit("Receipt checked, amount "), F.coalesce("subject", F.lit("0.0")), F.lit(" INR")))
        .when(module == "fraud_dna", "Event joins a known campaign")
        .otherwise(F.concat(F.lit("Signal from "), module)))
    return df.select(
        "event_id", "ts", "module", L.threat_level(level, score).alias("threat_level"), summary.alias("summary"),
        score.alias("risk_score"), F.upper(F.coalesce("ai_verdict", default_verdict)).alias("ai_verdict"),
        F.when(F.size(first) == 0, F.array(F.lit("unspecified"))).otherwise(first).alias("indicators"),
        F.coalesce("drift_status", F.lit("stable")).alias("drift_status"))


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Event counts per window and source. On a stream, rows later than the watermark are dropped."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, width).alias("w"), "source_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("risk_level").isin("CRITICAL", "HIGH")).alias("urgent")).select(
        F.col("w.start").alias("start"), "source_type", "n", "urgent")


def labelled_errors(preds: DataFrame, truths: DataFrame, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Prediction errors (module, ts, event_id, error) for predictions whose truth is known.

    On streams this is an inner stream-stream join bounded by the watermarks and ``within``.
    """
    p = preds.select("module", "ts", "event_id", "score")
    t = truths.select(F.col("event_id").alias("_id"), F.col("ts").alias("_tts"), "truth").where(F.col("truth").isNotNull())
    cond = F.col("event_id") == F.col("_id")
    if preds.isStreaming:
        p, t = p.withWatermark("ts", late), t.withWatermark("_tts", late)
        cond = cond & F.expr(f"_tts BETWEEN ts AND ts + INTERVAL {within}")
    wrong = (F.col("score") >= 50) != LB.is_positive(F.col("truth"))
    return p.join(t, cond).select("module", "ts", "event_id", wrong.cast("int").alias("error"))


def drop_repeats(df: DataFrame, key: str = "payload_hash", time: str = "ts", ttl_seconds: int = 600, order: tuple[str, ...] = ()) -> DataFrame:
    """Suppress payloads already accepted within the TTL; a suppressed row doesn't renew it.

    Stream: state per payload, dropped by the watermark; there, too, only accepted rows start a TTL. Batch: the accepted
    times of a payload are a chain, each the first one later than its predecessor plus the TTL. Successors come from joins
    on slices of one TTL; the chain is marked by pointer doubling, in rounds that grow with the logarithm of its length, so
    no payload is one task. Of rows with equal time the first by ``order`` is accepted.
    """
    if df.isStreaming:
        return df.withWatermark(time, f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark([key])
    ttl = ttl_seconds * 1_000_000
    at = F.unix_micros(F.col(time).cast("timestamp"))
    times = df.select(F.col(key).alias("k"), at.alias("t")).distinct().withColumn("s", F.floor(F.col("t") / ttl))
    times = cut_lineage(times)
    slices = times.groupBy("k", "s").agg(F.min("t").alias("least"))
    later = slices.select("k", "s", F.lead("least").over(Window.partitionBy("k").orderBy("s")).alias("then"),
                          F.lead("s").over(Window.partitionBy("k").orderBy("s")).alias("s2"), "least")
    # A successor lies in the next slice, or is the first time of the first slice after that.
    near = times.alias("a").join(times.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.s") + 1 == F.col("b.s")) & (F.col("b.t") > F.col("a.t") + ttl), "left")
    near = near.groupBy("a.k", "a.t", "a.s").agg(F.min("b.t").alias("near"))
    after = later.alias("x").join(later.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.s2") == F.col("y.s")), "left").select(
        F.col("x.k").alias("k"), F.col("x.s").alias("s"), F.when(F.col("x.s2") > F.col("x.s") + 1, F.col("x.then")).otherwise(F.col("y.then")).alias("far"))
    jump = cut_lineage(near.join(after, ["k", "s"]).select("k", F.col("t").alias("at"), F.coalesce("near", "far").alias("to")).where("to IS NOT NULL"))
    reached = cut_lineage(times.groupBy("k").agg(F.min("t").alias("at")))
    while not jump.isEmpty():
        reached = cut_lineage(reached.union(reached.join(jump, ["k", "at"]).select("k", F.col("to").alias("at"))).distinct())
        onward = jump.select("k", F.col("at").alias("to"), F.col("to").alias("_next"))
        jump = cut_lineage(jump.join(onward, ["k", "to"]).select("k", "at", F.col("_next").alias("to")))
    first = F.row_number().over(Window.partitionBy("_k", "_at").orderBy(*(order or [F.lit(1)])))
    rows = df.withColumns({"_k": F.col(key), "_at": at}).join(reached.select(F.col("k").alias("_k"), F.col("at").alias("_at")), ["_k", "_at"], "left_semi")
    return rows.withColumn("_first", first).where("_first = 1").select(*df.columns)


def spacing_violations(df: DataFrame, client: str = "client", time: str = "ts", min_ms: int = 100) -> DataFrame:
    """Messages of a client closer than ``min_ms`` to the one before.

    Hour slices keep the windows small for clients that never stop; the first message of a slice
    looks at the last message of the slice before.
    """
    base = df.withColumn("_us", F.unix_micros(F.col(time).cast("timestamp"))).withColumn(
        "_slice", F.floor(F.col("_us") / 3_600_000_000))
    last = base.groupBy(client, "_slice").agg(F.max("_us").alias("_last")).withColumn("_slice", F.col("_slice") + 1)
    inside = base.withColumn("_prev", F.lag("_us").over(Window.partitionBy(client, "_slice").orderBy("_us")))
    gap = (F.col("_us") - F.coalesce("_prev", "_last")) / 1000.0
    return inside.join(last, [client, "_slice"], "left").withColumn("gap_ms", gap).where(
        F.col("gap_ms") < min_ms).select(*df.columns, "gap_ms")


def alert_fanout(alerts: DataFrame, table_path: str, urgent_path: str, checkpoint: str) -> DataStreamWriter:
    """Write every alert to a table and urgent ones to a second sink, once per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        tagged = batch.withColumn("batch_id", F.lit(batch_id))
        # Re-runs of a batch overwrite its own folder, which makes both sinks idempotent.
        tagged.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")
        tagged.where(F.col("severity").isin("critical", "high")).write.mode("overwrite").parquet(
            f"{urgent_path}/batch={batch_id}")
        batch.unpersist()

    return alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
