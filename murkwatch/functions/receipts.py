"""Payment-receipt text as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import clip, contains_any, count_char, count_hits, found_words, hit, hits, lit_array, strip

# Words whose presence marks a payment screenshot.
SIGNAL_WORDS = [
    "phonepe", "gpay", "google pay", "paytm", "bhim", "upi", "utr", "transaction id", "txn id", "ref no",
    "payment successful", "paid to", "sent to", "received from", "okaxis", "okhdfcbank", "oksbi", "okicici",
    "ybl", "ibl", "payment", "₹", "rs.", "inr",
]
BAD_WORDS = ["scam", "refund", "failed", "reversed", "fake", "cancelled", "void", "generated"]
PAYEE_LABELS = ["paid to", "to:", "received by", "credited to"]
RECEIVER_LABELS = ["paid to", "to:", "received by"]
# App keywords in tie-break order, brand colours and palettes.
APP_KEYWORDS = {
    "PhonePe": ["phonepe", "ybl", "axl", "ibl", "ybl@upi", "axl@upi"],
    "GPay": ["google pay", "gpay", "okaxis", "okhdfcbank", "oksbi", "okicici", "google", "g-pay"],
    "Paytm": ["paytm", "pg.paytm", "pytm", "paytm wallet", "paytm cash"],
    "BHIM": ["bhim", "upi@upi", "bhim upi", "bharat interface"],
}
PALETTES = {
    "PhonePe": [(95, 37, 159), (255, 255, 255)],
    "GPay": [(66, 133, 244), (255, 255, 255)],
    "Paytm": [(0, 41, 112), (255, 255, 255)],
    "BHIM": [(255, 153, 51), (19, 136, 8), (255, 255, 255)],
}
PALETTE_LIMIT = 85.0
# Patterns for references, handles and amounts.
LABELLED_REF = (
    r"(?i)(?:utr|upi\s+ref|transaction\s+id|txn\s+id|ref\s+no|upi\s+transaction\s+id|bank\s+reference\s+id)"
    r"\s*[:#-]?\s*([a-zA-Z0-9]{10,18})"
)
TWELVE_DIGITS = r"\b(\d{12})\b"
T_REFERENCE = r"\b(T\d{10,17})\b"
HANDLE = r"\b[a-z0-9._\-]+@[a-z0-9]+\b"
AMOUNT = r"([\d,]+(?:\.\d{1,2})?)"
APP_CODES = {"phonepe": 0, "phonepay": 0, "googlepay": 1, "google pay": 1, "gpay": 1, "paytm": 2}


# ---- references -----------------------------------------------------------

def normalize_utr(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), "[^a-zA-Z0-9]", "")


def classify_utr(norm: Column) -> Column:
    """(format, valid, confidence) of a normalised reference."""
    n = F.length(norm)
    fits = n.between(10, 18)

    def verdict(fmt: str, valid: bool, conf: float) -> Column:
        return F.struct(F.lit(fmt).alias("format"), F.lit(valid).alias("valid"), F.lit(conf).alias("confidence"))

    return (
        F.when(n == 0, verdict("invalid", False, 0.0))
        .when(norm.rlike(r"^\d{12}$"), verdict("phonepe_numeric_12", True, 0.95))
        .when(norm.rlike(r"^T\d+$") & fits, verdict("paytm_t_prefix", True, 0.90))
        .when(fits & norm.rlike("[a-zA-Z]") & norm.rlike(r"\d"), verdict("gpay_alphanumeric", True, 0.85))
        .when(fits, verdict("generic", True, 0.70))
        .otherwise(verdict("invalid", False, 0.10))
    )


def validate_utr(norm: Column, app: Column) -> Column:
    """Classification with the app rule: PhonePe receipts carry twelve digits."""
    base = classify_utr(norm)
    off = F.coalesce(F.lower(app).contains("phonepe"), F.lit(False)) & (base["format"] != "phonepe_numeric_12")
    return F.struct(
        base["format"].alias("format"),
        (base["valid"] & ~off).alias("valid"),
        F.when(off, F.least(base["confidence"], F.lit(0.40))).otherwise(base["confidence"]).alias("confidence"),
    )


def utr_candidates(text: Column) -> Column:
    """Candidate references in pass order (labelled, twelve digits, T form), first sighting kept."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    found = F.concat(*[
        F.regexp_extract_all(flat, F.lit(p), F.lit(1)) for p in (LABELLED_REF, TWELVE_DIGITS, T_REFERENCE)
    ])
    return F.array_distinct(F.filter(F.transform(found, normalize_utr), lambda v: v != ""))


# ---- amounts and handles ----------------------------------------------------

def _number(raw: Column) -> Column:
    return F.replace(raw, F.lit(","), F.lit("")).try_cast("double")


def parse_amount(text: Column) -> Column:
    """First parsable of: ₹ sign, rs prefix, inr prefix, amount label, grouped decimal."""
    low = F.lower(text)
    fallback = F.get(F.regexp_extract_all(low, F.lit(r"\b\d{1,3}(?:,\d{2,3})*(?:\.\d{2})\b"), F.lit(0)), 0)
    return F.coalesce(
        _number(F.regexp_extract(text, r"₹\s*" + AMOUNT, 1)),
        _number(F.regexp_extract(low, r"rs\.?\s*" + AMOUNT, 1)),
        _number(F.regexp_extract(low, r"inr\s*" + AMOUNT, 1)),
        _number(F.regexp_extract(low, r"(?:amount|paid|total)[:\s]+" + AMOUNT, 1)),
        _number(fallback),
    )


def handles(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(HANDLE), F.lit(0))


def pick_after_label(low_text: Column, vpas: Column, labels: list[str], fallback: Column) -> Column:
    """First handle (list order) present after the first label that has one."""
    picks = []
    for label in labels:
        at = F.instr(low_text, label)
        tail = F.substring(low_text, at, 1 << 30)
        picks.append(F.when(at > 0, F.get(F.filter(vpas, lambda v: F.contains(tail, v)), 0)))
    return F.when(F.size(vpas) == 0, None).otherwise(F.coalesce(*picks, fallback))


def select_payee(text: Column, vpas: Column) -> Column:
    return pick_after_label(F.lower(text), vpas, PAYEE_LABELS, F.element_at(vpas, -1))


def is_receipt(text: Column) -> Column:
    """At least two signal words, or one together with a handle or a 12-digit number."""
    n = count_hits(F.lower(text), SIGNAL_WORDS)
    other = text.rlike(r"\b[a-zA-Z0-9._\-]+@[a-zA-Z0-9]+\b") | text.rlike(r"\b\d{12}\b")
    return (n >= 2) | ((n >= 1) & other)


def quick_parse(text: Column) -> dict[str, Column]:
    """The short parser: any 12-digit reference, first handle as sender, labelled receiver, amount."""
    low = F.lower(text)
    vpas = F.regexp_extract_all(low, F.lit(r"[a-z0-9._\-]+@[a-z0-9]+"), F.lit(0))
    utr = F.regexp_extract(low, TWELVE_DIGITS, 1)
    last = F.when(F.size(vpas) > 1, F.element_at(vpas, -1))
    amount = _number(F.regexp_extract(low, r"(?:rs\.?|inr|amount)\s*([\d,]+(?:\.\d{2})?)", 1))
    return {
        "utr": F.when(utr != "", utr),
        "sender": F.get(vpas, 0),
        "receiver": pick_after_label(low, vpas, RECEIVER_LABELS, last),
        "amount": F.coalesce(amount, F.lit(0.0)),
    }


# ---- app and colours -----------------------------------------------------------

def _hex_part(color: Column, start: int) -> Column:
    return F.conv(F.substring(color, start, 2), 16, 10).cast("int")


def _color_points(colors: Column) -> dict[str, Column]:
    """Points per app from dominant colours given as an array of hex strings."""
    clean = F.filter(
        F.transform(colors, lambda c: F.regexp_replace(F.lower(F.trim(c)), "^#+", "")),
        lambda c: c.rlike("^[0-9a-f]{6}$"))

    def total(rule) -> Column:
        return F.aggregate(clean, F.lit(0), lambda acc, c: acc + rule(_hex_part(c, 1), _hex_part(c, 3), _hex_part(c, 5)))

    def when(cond: Column, points: int) -> Column:
        return F.when(cond, points).otherwise(0)

    return {
        "PhonePe": total(lambda r, g, b: when((r > 80) & (b > 120) & (g < 70), 3)),
        "GPay": total(lambda r, g, b: when((r > 20) & (r < 120) & (g > 100) & (g < 180) & (b > 180), 3)),
        "Paytm": total(lambda r, g, b: when((r < 30) & (g > 20) & (g < 80) & (b > 80) & (b < 150), 3)),
        "BHIM": total(lambda r, g, b: when((r > 200) & (g > 120) & (g < 180) & (b < 80), 2)
                      + when((r < 40) & (g > 100) & (b < 40), 2)),
    }


def app_points(text: Column, colors: Column | None = None) -> dict[str, Column]:
    low = F.lower(text)
    points = {app: 2 * count_hits(low, words) for app, words in APP_KEYWORDS.items()}
    if colors is not None:
        extra = _color_points(colors)
        points = {app: p + F.coalesce(extra[app], F.lit(0)) for app, p in points.items()}
    return points


def pick_app(points: dict[str, Column]) -> tuple[Column, Column]:
    """(app, confidence); ties go to the earlier app."""
    top = F.greatest(*points.values())
    app = F.when(top == 0, "Unknown")
    for name, p in points.items():
        app = app.when(p == top, name)
    conf = F.when(top == 0, 0.20).otherwise(F.least(F.lit(0.95), F.lit(0.40) + top * 0.10))
    return app, conf


def palette_distance(rgbs: Column, app: Column) -> tuple[Column, Column]:
    """(distance to any anchor, distance to the primary colour) over the top three colours."""

    def nearest(anchors) -> Column:
        dists = F.flatten(F.transform(F.slice(rgbs, 1, 3), lambda c: F.array(*[
            F.sqrt(F.pow(c["r"] - r, 2) + F.pow(c["g"] - g, 2) + F.pow(c["b"] - b, 2)) for r, g, b in anchors])))
        return F.array_min(dists)

    any_d = F.lit(None).cast("double")
    first_d = F.lit(None).cast("double")
    for name, anchors in PALETTES.items():
        any_d = F.when(app == name, nearest(anchors)).otherwise(any_d)
        first_d = F.when(app == name, nearest(anchors[:1])).otherwise(first_d)
    return any_d, first_d


def palette_confidence(authentic: Column, distance: Column) -> Column:
    return (
        F.when(distance.isNull(), 0.50)
        .when(authentic, F.least(F.lit(0.98), 0.95 - distance / PALETTE_LIMIT * 0.30))
        .otherwise(F.least(F.lit(0.95), 0.40 + distance / 440.0 * 0.40))
    )


# ---- scoring ----------------------------------------------------------------------

def receipt_indicators(text, utr_valid, color_ok, tamper, font_ok, ocr_conf) -> Column:
    bad = found_words(F.lower(text), BAD_WORDS)
    low_conf = (F.coalesce(ocr_conf, F.lit(1.0)) < 0.50) | (strip(text) == "")
    no = F.lit(False)
    return hits(
        hit(~F.coalesce(utr_valid, no), "invalid_or_missing_utr", 25, "Missing or invalid UTR reference."),
        hit(~F.coalesce(color_ok, no), "brand_color_mismatch", 15, "Colour profile does not match the app's brand."),
        hit(F.coalesce(tamper, no), "ela_tamper_detected", 30, "Error level analysis suggests an edited overlay."),
        hit(~F.coalesce(font_ok, no), "font_inconsistent", 20, "Text heights vary, hinting at spliced fonts."),
        hit(low_conf, "low_ocr_confidence", 10, "Receipt text is unreadable or of low confidence."),
        hit(F.size(bad) > 0, "suspicious_keywords", 10, F.concat(
            F.lit("Suspicious words: "), F.array_join(bad, ", "), F.lit("."))),
    )


def receipt_confidence(score: Column, indicators: Column) -> Column:
    mean = F.aggregate(indicators, F.lit(0.0), lambda a, h: a + h["score"]) / F.size(indicators)
    return F.when(F.size(indicators) == 0, 0.5).otherwise(
        clip(score / 100.0 * 0.7 + mean / 50.0 * 0.3, 0.0, 1.0))


def visual_fusion(color_ok, color_distance, font_ok, variance, tamper, ela_score, hotspot, verdict, conf) -> dict[str, Column]:
    """Four-signal score 0..100: colour, font and error-level 20 % each, visual verdict 40 %."""
    yes = F.lit(True)
    zero = F.lit(0.0)
    ela = F.coalesce(ela_score.cast("double"), zero)
    sure = F.coalesce(conf, F.lit(50.0))
    parts = {
        "color_part": F.when(~F.coalesce(color_ok, yes), 100.0).otherwise(
            F.least(F.lit(100.0), F.coalesce(color_distance, zero) * 400.0)),
        "font_part": F.when(~F.coalesce(font_ok, yes), 100.0).otherwise(
            F.least(F.lit(100.0), F.coalesce(variance, zero) * 800.0)),
        "ela_part": F.when(F.coalesce(tamper, F.lit(False)), F.greatest(
            ela, F.coalesce(hotspot, zero) * 100.0, F.lit(60.0))).otherwise(ela),
        "visual_part": F.when(verdict == "FORGED", F.greatest(F.lit(70.0), sure))
        .when(F.coalesce(verdict, F.lit("SUSPICIOUS")) == "SUSPICIOUS", sure)
        .otherwise(F.least(F.lit(30.0), 100.0 - sure)),
    }
    total = (parts["color_part"] * 0.20 + parts["font_part"] * 0.20 + parts["ela_part"] * 0.20
             + parts["visual_part"] * 0.40)
    return {**parts, "enhanced_score": clip(total, 0.0, 100.0)}


def utr_baseline(utr: Column) -> tuple[Column, Column]:
    u = strip(F.coalesce(utr, F.lit("")))
    digits = u.rlike(r"^\d+$")
    score = (
        F.when(u == "", 90).when(~digits, 95).when(F.length(u) != 12, 85)
        .when(~F.substring(u, 1, 1).isin("3", "4", "5", "6"), 40).otherwise(0)
    )
    return score, F.when(score >= 85, "HIGH").when(score == 40, "SUSPICIOUS").otherwise("CLEAN")


def fallback_score(utr: Column, amount: Column) -> Column:
    ok = F.length(F.coalesce(utr, F.lit(""))) == 12
    return F.when(~ok, 65).when(amount < 50000, 15).otherwise(45)


# ---- feature vectors -----------------------------------------------------------------

def ocr_features(text: Column, conf: Column) -> dict[str, Column]:
    """Text part of the wide feature vector; all 0 for empty text."""
    low = F.lower(text)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    rs = F.regexp_count(low, F.lit(r"rs\."))
    values = {
        "ocr_length": F.length(text), "ocr_words": F.size(words), "ocr_digits": F.regexp_count(text, F.lit(r"\d")),
        "ocr_handles": count_char(low, "@"),
        "ocr_amounts": count_char(low, "₹") + rs + F.regexp_count(low, F.lit("inr")) + F.regexp_count(
            low, F.lit(r"\d{1,3}(?:,\d{2,3})+(?:\.\d{2})?")),
        "ocr_dates": F.regexp_count(low, F.lit(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}")),
        "ocr_confidence_value": F.coalesce(conf, F.lit(0.0)), "ocr_low_conf_ratio": F.lit(0.0),
        "has_paid_to": low.contains("paid to"), "has_received_by": low.contains("received by"),
        "has_successful": low.contains("successful"), "has_currency": text.contains("₹") | low.contains("rs."),
    }
    return {k: F.when(text == "", 0.0).otherwise(v.cast("double")) for k, v in values.items()}


def utr_features(text: Column, ref: Column) -> dict[str, Column]:
    """Eight features of the first 10-18 character token (``ref``; '' when absent)."""
    low = F.lower(text)
    at = F.instr(low, F.lower(ref))
    labelled = None
    for label in ("utr", "ref", "txn", "transaction id"):
        pos = F.instr(low, label)
        here = (pos > 0) & (pos <= at + 5)
        labelled = here if labelled is None else labelled | here
    values = {
        "utr_present": F.lit(True), "utr_length": F.length(ref), "utr_twelve_digits": ref.rlike(r"^\d{12}$"),
        "utr_t_form": ref.rlike(r"^T\d+$"), "utr_mixed": ref.rlike("[a-zA-Z]") & ref.rlike(r"\d"),
        "utr_length_ok": F.length(ref).between(10, 18), "utr_labelled": labelled, "utr_likely_real": F.lit(True),
    }
    return {k: F.when((text == "") | (ref == ""), 0.0).otherwise(v.cast("double")) for k, v in values.items()}


def baseline_ocr_features(text: Column, conf: Column) -> dict[str, Column]:
    low = F.lower(text)
    twelve = text.rlike(r"\b\d{12}\b")
    values = {
        "utr_extracted": twelve | low.contains("utr") | low.contains("txn"),
        "amount_extracted": low.rlike(r"(?:rs\.?|inr|₹)\s?\d+"),
        "recipient_extracted": contains_any(
            low, ["paid to", "to:", "transfer to", "payment to", "@upi", "@ok", "upi id"]),
        "utr_format_valid": twelve,
        "amount_format_valid": text.rlike(r"\b\d+(?:\.\d{2})?\b"),
        "ocr_confidence_value": conf,
    }
    return {k: v.cast("double") for k, v in values.items()}


def app_code(app: Column) -> Column:
    code = F.lit(3.0)
    name = F.trim(F.lower(F.coalesce(app, F.lit("unknown"))))
    for word, value in APP_CODES.items():
        code = F.when(name == word, float(value)).otherwise(code)
    return code
