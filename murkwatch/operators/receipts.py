"""Receipt jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import levels as L
from ..functions import receipts as R
from ..functions.exprs import finite, hit_total, pin


def parse(df: DataFrame, text: str = "ocr_text", app: str = "app") -> DataFrame:
    """Append gate result, references, amount, handles and the app-aware reference check."""
    t = F.col(text)
    # Only columns that later rules read are pinned; the rest is dropped by the optimizer when unused.
    base = pin(df, {"utr_candidates": R.utr_candidates(t), "vpas": R.handles(t)}).withColumns({
        "is_receipt": R.is_receipt(t),
        "utr": F.get("utr_candidates", 0),
        "amount": R.parse_amount(t),
        "payee_vpa": R.select_payee(t, F.col("vpas")),
    })
    return pin(base, {"utr_check": R.validate_utr(R.normalize_utr(F.col("utr")), F.col(app))})


def score(parsed: DataFrame, text: str = "ocr_text") -> DataFrame:
    """Append indicators, forgery_score, verdict and confidence."""
    ind = R.receipt_indicators(
        F.col(text), F.col("utr_check.valid"), F.col("color_authentic"), F.col("tamper_suspected"),
        F.col("font_consistent"), F.col("ocr_confidence"))
    out = pin(parsed, {"indicators": ind})
    out = pin(out, {"forgery_score": F.least(hit_total("indicators"), F.lit(100))})
    return out.withColumns({
        "verdict": L.receipt_verdict(F.col("forgery_score")),
        "confidence": R.receipt_confidence(F.col("forgery_score"), F.col("indicators")),
    })


def lookup_utr(requests: DataFrame, past: DataFrame, min_score: int = 60) -> DataFrame:
    """Check references (column utr) against past fraud rows (utr_number, risk_score).

    The fraud side is reduced to distinct references before the join, so a reference reported a
    billion times joins as one row.
    """
    bad = (
        past.where(F.col("risk_score") >= min_score).select(F.col("utr_number").alias("_bad")).distinct()
    )
    clean = requests.withColumn("utr_clean", F.regexp_replace("utr", r"\D", ""))
    joined = clean.join(bad, F.col("utr_clean") == F.col("_bad"), "left").withColumns({
        "is_valid": F.length("utr_clean") == 12,
        "known_fraud_match": F.col("_bad").isNotNull(),
    }).drop("_bad")
    risk = F.when(~F.col("is_valid"), 75).when(F.col("known_fraud_match"), 100).otherwise(0)
    return joined.withColumn("risk_score", risk).withColumn("risk_level", L.utr_level(F.col("risk_score")))


def feature_vector(df: DataFrame) -> DataFrame:
    """Append the eight model features of an analysed receipt."""
    yes = F.lit(1.0)
    flag = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), yes).otherwise(0.0)
    return df.withColumns({
        "f_forgery_score_heuristic": F.least(finite(F.col("forgery_score")), F.lit(100.0)) / 100.0,
        "f_utr_valid": F.when(F.coalesce(F.col("utr_check.valid"), F.lit(False)), yes).otherwise(0.0),
        "f_utr_length": F.length(R.normalize_utr(F.col("utr"))).cast("double"),
        "f_ela_tamper_regions": finite(F.col("hotspot_ratio")),
        "f_font_consistent": flag("font_consistent"),
        "f_color_authentic": flag("color_authentic"),
        "f_ocr_confidence": F.least(finite(F.col("ocr_confidence")), F.lit(100.0)) / 100.0,
        "f_app_detected_encoded": R.app_code(F.col("app")),
    })


def dominant_colors(pixels: DataFrame, image: str = "image_id", keep: int = 5) -> DataFrame:
    """Top colours per image from rows (image_id, r, g, b) on a 32-wide grid.

    Counts are combined map-side, so the window sees at most 512 buckets per image.
    """
    grid = lambda c: F.least(F.lit(255), F.floor(F.col(c) / 32).cast("int") * 32 + 16)
    counts = pixels.groupBy(image, grid("r").alias("r"), grid("g").alias("g"), grid("b").alias("b")).agg(
        F.count("*").alias("n"))
    per_image = Window.partitionBy(image)
    ranked = counts.withColumns({
        "pct": F.bround(F.col("n") / F.sum("n").over(per_image), 4),
        "rank": F.row_number().over(per_image.orderBy(F.desc("n"), "r", "g", "b")),
    })
    hexed = F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in ("r", "g", "b")]))
    return ranked.where(F.col("rank") <= keep).withColumn("hex", hexed)


def color_check(df: DataFrame, rgbs: str = "rgbs", app: str = "app") -> DataFrame:
    """Append distance, color_ok and confidence from an array of dominant (r, g, b) structs."""
    any_d, first_d = R.palette_distance(F.col(rgbs), F.col(app))
    out = pin(df, {"distance": any_d, "_primary": first_d})
    ok = F.col("distance").isNull() | (
        (F.col("distance") <= R.PALETTE_LIMIT) & (F.col("_primary") <= R.PALETTE_LIMIT))
    out = out.withColumn("color_ok", ok)
    return out.withColumn("color_confidence", R.palette_confidence(F.col("color_ok"), F.col("distance"))).drop("_primary")


def font_check(components: DataFrame, image: str = "image_id", app: str = "app") -> DataFrame:
    """Text-height variance per image from component boxes (w, h)."""
    usable = components.where(F.col("h").between(6, 45) & F.col("w").between(3, 180))
    stats = usable.groupBy(image, app).agg(F.count("*").alias("component_count"), F.var_pop("h").alias("_var"))
    limit = F.when(F.lower(F.col(app)).isin("phonepe", "gpay"), 160.0).otherwise(110.0)
    few = F.col("component_count") < 8
    var = F.when(few, 0.0).otherwise(F.col("_var"))
    out = stats.withColumn("height_variance", F.round(var, 4)).withColumn("font_ok", few | (F.col("_var") <= limit))
    conf = (
        F.when(few, 0.60)
        .when(F.col("font_ok"), F.least(F.lit(0.95), 0.90 - F.col("_var") / 200.0 * 0.15))
        .otherwise(F.least(F.lit(0.95), 0.50 + F.col("_var") / 400.0 * 0.35))
    )
    return out.withColumn("font_confidence", F.round(conf, 4)).drop("_var")


def ela_screen(df: DataFrame) -> DataFrame:
    """Append tamper flag and score for screenshot error-level statistics."""
    strong = (F.col("hotspot_ratio") > 0.12) | (F.col("mean_diff") > 8.0)
    weak = (F.col("hotspot_ratio") > 0.06) | (F.col("mean_diff") > 4.0)
    return df.withColumn("ela_points", F.when(strong, 35).when(weak, 15).otherwise(0)).withColumn(
        "ela_suspected", F.col("ela_points") > 0)


def ela_pages(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Document form: per-page classes rolled up to the page with the strongest signal."""
    h, m = F.col("hotspot_ratio"), F.col("mean_diff")
    suspicious = (h > 0.15) | (m > 8.0) | (h > 0.08)
    points = F.when(h > 0.15, 30).when(h > 0.08, 10).otherwise(0)
    return pages.groupBy(doc).agg(
        F.max(F.when(suspicious, points).otherwise(0)).alias("ela_points"),
        F.count_if(suspicious).alias("suspicious_pages"), F.count("*").alias("pages_analyzed"))


def event_rows(scored: DataFrame) -> DataFrame:
    """Receipt events for the event table, with an explanation line per indicator."""
    lines = F.array_join(F.transform("indicators", lambda i: F.concat(
        F.lit("- "), i["detail"], F.lit(": "), i["score"].cast("string"), F.lit(" points"))), "\n")
    clean = F.lit("No signal fired.")
    return scored.select(
        F.col("receipt_id").alias("id"), F.col("seen_at").alias("timestamp"), F.lit("screenshot").alias("event_type"),
        F.col("utr").alias("utr_number"), F.get("vpas", 0).alias("sender_upi_id"),
        F.col("payee_vpa").alias("receiver_upi_id"), "amount",
        F.col("utr_check.valid").cast("int").alias("is_valid_utr"),
        (~F.col("font_consistent")).cast("int").alias("font_anomalies_detected"),
        F.exists("indicators", lambda i: i["rule"] == "suspicious_keywords").cast("int").alias("suspicious_handle_flagged"),
        F.col("forgery_score").alias("risk_score"), F.col("verdict").alias("risk_level"),
        F.when(F.size("indicators") == 0, clean).otherwise(lines).alias("explanation"),
        F.to_json(F.struct("app", "ela_score", "hotspot_ratio", "height_variance", "color_distance")).alias("metadata_json"),
    )
