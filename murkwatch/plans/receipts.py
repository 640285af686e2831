"""Receipt queries."""

from pyspark.sql import functions as F

from ..functions import levels as L
from ..functions import receipts as R
from ..functions.exprs import hit_rules, pin
from ..operators import receipts as ops
from ..session import cut_lineage
from . import inputs  # noqa: F401
from .registry import Data, query, sql_array

# ---- SQL twins: shared text --------------------------------------------------

CAND = r"""raw AS (SELECT *, replace(ocr_text, chr(10), ' ') AS flat, lower(ocr_text) AS low FROM {receipts}), cand AS (
  SELECT *, list_concat(list_concat(regexp_extract_all(flat, '(?i)(?:utr|upi\s+ref|transaction\s+id|txn\s+id|ref\s+no|upi\s+transaction\s+id|bank\s+reference\s+id)\s*[:#-]?\s*([a-zA-Z0-9]{10,18})', 1),
    regexp_extract_all(flat, '\b(\d{12})\b', 1)), regexp_extract_all(flat, '\b(T\d{10,17})\b', 1)) AS all_c,
    regexp_extract_all(low, '\b[a-z0-9._\-]+@[a-z0-9]+\b') AS vpas FROM raw), dist AS (
  SELECT *, list_filter(all_c, lambda v, i: list_position(all_c, v) = i) AS cands FROM cand), utr1 AS (
  SELECT *, cands[1] AS utr, coalesce(cands[1], '') AS nutr FROM dist), fmt AS (
  SELECT *, CASE WHEN nutr = '' THEN 'invalid' WHEN regexp_matches(nutr, '^\d{12}$') THEN 'phonepe_numeric_12'
      WHEN regexp_matches(nutr, '^T\d+$') AND length(nutr) BETWEEN 10 AND 18 THEN 'paytm_t_prefix'
      WHEN length(nutr) BETWEEN 10 AND 18 AND regexp_matches(nutr, '[a-zA-Z]') AND regexp_matches(nutr, '\d') THEN 'gpay_alphanumeric'
      WHEN length(nutr) BETWEEN 10 AND 18 THEN 'generic' ELSE 'invalid' END AS fmt FROM utr1), chk AS (
  SELECT *, fmt <> 'invalid' AND NOT (app = 'PhonePe' AND fmt <> 'phonepe_numeric_12') AS valid,
    CASE fmt WHEN 'phonepe_numeric_12' THEN 0.95 WHEN 'paytm_t_prefix' THEN 0.90 WHEN 'gpay_alphanumeric' THEN 0.85 WHEN 'generic' THEN 0.70
      ELSE CASE WHEN nutr = '' THEN 0.0 ELSE 0.10 END END::DOUBLE AS base_conf FROM fmt)"""

AMT = r"""coalesce(TRY_CAST(replace(regexp_extract(ocr_text, '₹\s*([\d,]+(?:\.\d{1,2})?)', 1), ',', '') AS DOUBLE),
    TRY_CAST(replace(regexp_extract(low, 'rs\.?\s*([\d,]+(?:\.\d{1,2})?)', 1), ',', '') AS DOUBLE),
    TRY_CAST(replace(regexp_extract(low, 'inr\s*([\d,]+(?:\.\d{1,2})?)', 1), ',', '') AS DOUBLE),
    TRY_CAST(replace(regexp_extract(low, '(?:amount|paid|total)[:\s]+([\d,]+(?:\.\d{1,2})?)', 1), ',', '') AS DOUBLE),
    TRY_CAST(replace(regexp_extract_all(low, '\b\d{1,3}(?:,\d{2,3})*(?:\.\d{2})\b')[1], ',', '') AS DOUBLE))"""


def _payee(labels, last):
    picks = ", ".join(
        f"CASE WHEN position('{w}' IN low) > 0 THEN list_filter(vpas, lambda v: contains(substr(low, position('{w}' IN low)), v))[1] END"
        for w in labels)
    return f"CASE WHEN len(vpas) > 0 THEN coalesce({picks}, {last}) END"


HITS = f"list_count(list_filter({sql_array(R.SIGNAL_WORDS)}, lambda w: contains(low, w)))"
GATE = (rf"({HITS} >= 2 OR ({HITS} >= 1 AND (regexp_matches(ocr_text, '\b[a-zA-Z0-9._\-]+@[a-zA-Z0-9]+\b')"
        r" OR regexp_matches(ocr_text, '\b\d{12}\b'))))")
IND = CAND + """, ind AS (
  SELECT *, list_filter([CASE WHEN NOT valid THEN 'invalid_or_missing_utr' END, CASE WHEN NOT color_authentic THEN 'brand_color_mismatch' END,
    CASE WHEN tamper_suspected THEN 'ela_tamper_detected' END, CASE WHEN NOT font_consistent THEN 'font_inconsistent' END,
    CASE WHEN ocr_confidence < 0.5 OR trim(ocr_text) = '' THEN 'low_ocr_confidence' END,
    CASE WHEN len(list_filter(%s, lambda w: contains(low, w))) > 0 THEN 'suspicious_keywords' END], lambda r: r IS NOT NULL) AS rules FROM chk), pts AS (
  SELECT *, list_transform(rules, lambda r: CASE r WHEN 'invalid_or_missing_utr' THEN 25 WHEN 'brand_color_mismatch' THEN 15 WHEN 'ela_tamper_detected' THEN 30
    WHEN 'font_inconsistent' THEN 20 ELSE 10 END) AS points FROM ind), sc AS (
  SELECT *, least(100, coalesce(list_sum(points), 0))::INT AS score FROM pts), ver AS (
  SELECT *, CASE WHEN score >= 60 THEN 'LIKELY_FORGED' WHEN score >= 30 THEN 'SUSPICIOUS' ELSE 'GENUINE' END AS verdict FROM sc)""" % sql_array(R.BAD_WORDS)


def _parsed(d: Data):
    return ops.parse(d.receipts)


def _scored(d: Data):
    return ops.score(_parsed(d))


@query("rcp1_normalize_utr", "SELECT receipt_id, regexp_replace(ocr_text, '[^a-zA-Z0-9]', '', 'g') AS normalized FROM {receipts}")
def rcp1(d: Data):
    return d.receipts.select("receipt_id", R.normalize_utr(F.col("ocr_text")).alias("normalized"))


@query("rcp2_classify_utr", f"WITH {CAND} SELECT fmt AS format, fmt <> 'invalid' AS valid, base_conf AS confidence, count(*) AS n FROM chk GROUP BY ALL")
def rcp2(d: Data):
    c = pin(_parsed(d), {"c": R.classify_utr(R.normalize_utr(F.col("utr")))})
    return c.groupBy("c.format", "c.valid", "c.confidence").agg(F.count("*").alias("n"))


@query("rcp3_validate_utr", f"""WITH {CAND} SELECT receipt_id, fmt AS format, valid,
  CASE WHEN app = 'PhonePe' AND fmt <> 'phonepe_numeric_12' THEN least(base_conf, 0.40) ELSE base_conf END AS confidence FROM chk""")
def rcp3(d: Data):
    return _parsed(d).select("receipt_id", "utr_check.format", "utr_check.valid", "utr_check.confidence")


@query("rcp4_utr_candidates", f"WITH {CAND} SELECT receipt_id, unnest(cands) AS candidate, generate_subscripts(cands, 1)::INT AS rank FROM dist")
def rcp4(d: Data):
    rows = d.receipts.select("receipt_id", F.posexplode(R.utr_candidates(F.col("ocr_text"))).alias("pos", "candidate"))
    return rows.select("receipt_id", "candidate", (F.col("pos") + 1).alias("rank"))


@query("rcp5_amount", f"WITH {CAND} SELECT receipt_id, {AMT} AS amount FROM raw")
def rcp5(d: Data):
    return d.receipts.select("receipt_id", R.parse_amount(F.col("ocr_text")).alias("amount"))


@query("rcp6_handles", f"WITH {CAND} SELECT receipt_id, array_to_string(vpas, '|') AS vpas FROM cand")
def rcp6(d: Data):
    return d.receipts.select("receipt_id", F.array_join(R.handles(F.col("ocr_text")), "|").alias("vpas"))


@query("rcp7_payee", f"WITH {CAND} SELECT receipt_id, {_payee(R.PAYEE_LABELS, 'vpas[-1]')} AS payee FROM cand")
def rcp7(d: Data):
    return _parsed(d).select("receipt_id", F.col("payee_vpa").alias("payee"))


@query("rcp8_quick_parse", rf"""WITH base AS (SELECT *, lower(ocr_text) AS low, regexp_extract_all(lower(ocr_text), '[a-z0-9._\-]+@[a-z0-9]+') AS vpas FROM {{receipts}})
  SELECT receipt_id, nullif(regexp_extract(low, '\b(\d{{12}})\b', 1), '') AS utr, vpas[1] AS sender,
  {_payee(R.RECEIVER_LABELS, 'CASE WHEN len(vpas) > 1 THEN vpas[-1] END')} AS receiver,
  coalesce(TRY_CAST(replace(regexp_extract(low, '(?:rs\.?|inr|amount)\s*([\d,]+(?:\.\d{{2}})?)', 1), ',', '') AS DOUBLE), 0.0) AS amount FROM base""")
def rcp8(d: Data):
    return d.receipts.select("receipt_id", *[c.alias(n) for n, c in R.quick_parse(F.col("ocr_text")).items()])


_PTS = ", ".join(
    f"2 * len(list_filter({sql_array(w)}, lambda k: contains(low, k))) + CASE c WHEN '{hexes}' THEN {p} ELSE 0 END AS p{i}"
    for i, ((a, w), hexes, p) in enumerate(zip(
        R.APP_KEYWORDS.items(), ["#5f259f", "#4285f4", "#002970", "#ff9933"], [3, 3, 3, 2])))
_COLOR = "CASE receipt_id % 5 WHEN 0 THEN '#5f259f' WHEN 1 THEN '#4285f4' WHEN 2 THEN '#002970' WHEN 3 THEN '#ff9933' ELSE '#zz' END"


@query("rcp9_detect_app", f"""WITH p AS (SELECT receipt_id, {_PTS} FROM (SELECT *, lower(ocr_text) AS low, {_COLOR} AS c FROM {{receipts}})), t AS (SELECT *, greatest(p0, p1, p2, p3) AS top FROM p)
  SELECT receipt_id, CASE WHEN top = 0 THEN 'Unknown' WHEN p0 = top THEN 'PhonePe' WHEN p1 = top THEN 'GPay' WHEN p2 = top THEN 'Paytm' ELSE 'BHIM' END AS detected,
  round(CASE WHEN top = 0 THEN 0.20 ELSE least(0.95, 0.40 + top * 0.10) END::DOUBLE, 6) AS confidence FROM t""")
def rcp9(d: Data):
    rows = d.receipts.withColumn("colors", F.array(F.expr(_COLOR)))
    pts = R.app_points(F.col("ocr_text"), F.col("colors"))
    rows = pin(rows, {f"p_{a}": c for a, c in pts.items()})
    app, conf = R.pick_app({a: F.col(f"p_{a}") for a in pts})
    return rows.select("receipt_id", app.alias("detected"), F.round(conf, 6).alias("confidence"))


@query("rcp10_forgery_score", f"WITH {IND} SELECT receipt_id, array_to_string(rules, '|') AS rules, score AS forgery_score, verdict FROM ver")
def rcp10(d: Data):
    return _scored(d).select(
        "receipt_id", F.array_join(hit_rules("indicators"), "|").alias("rules"), "forgery_score", "verdict")


@query("rcp11_confidence", f"""WITH {IND} SELECT verdict, count(*) AS n, round(sum(CASE WHEN len(points) = 0 THEN 0.5 ELSE
  greatest(0, least(1, score / 100.0::DOUBLE * 0.7::DOUBLE + list_avg(points) / 50.0::DOUBLE * 0.3::DOUBLE)) END), 6) AS total_confidence FROM ver GROUP BY verdict""")
def rcp11(d: Data):
    return _scored(d).groupBy("verdict").agg(
        F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("total_confidence"))


@query("rcp12_utr_lookup", rf"""WITH {IND}, asked AS (SELECT receipt_id, regexp_replace(utr, '\D', '', 'g') AS u FROM ver WHERE utr IS NOT NULL),
  bad AS (SELECT DISTINCT utr FROM ver WHERE score >= 60)
  SELECT receipt_id, length(u) = 12 AS is_valid, bad.utr IS NOT NULL AS known_fraud_match,
  CASE WHEN length(u) <> 12 THEN 75 WHEN bad.utr IS NOT NULL THEN 100 ELSE 0 END AS risk_score,
  CASE WHEN length(u) <> 12 THEN 'HIGH' WHEN bad.utr IS NOT NULL THEN 'HIGH' ELSE 'CLEAN' END AS risk_level
  FROM asked LEFT JOIN bad ON asked.u = bad.utr""")
def rcp12(d: Data):
    # Both sides read the scored rows: they are stored, not scored twice.
    rows = cut_lineage(_scored(d).select("receipt_id", "utr", "forgery_score"))
    past = rows.select(
        F.col("utr").alias("utr_number"), F.col("forgery_score").alias("risk_score"))
    asked = rows.where(F.col("utr").isNotNull()).select("receipt_id", "utr")
    return ops.lookup_utr(asked, past).select("receipt_id", "is_valid", "known_fraud_match", "risk_score", "risk_level")


@query("rcp13_utr_baseline", rf"""WITH {CAND}, s AS (SELECT receipt_id, CASE WHEN nutr = '' THEN 90 WHEN NOT regexp_matches(nutr, '^\d+$') THEN 95
  WHEN length(nutr) <> 12 THEN 85 WHEN nutr[1] NOT IN ('3', '4', '5', '6') THEN 40 ELSE 0 END AS score FROM utr1)
  SELECT receipt_id, score, CASE WHEN score >= 85 THEN 'HIGH' WHEN score = 40 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS label FROM s""")
def rcp13(d: Data):
    s, lab = R.utr_baseline(F.col("utr"))
    return _parsed(d).select("receipt_id", s.alias("score"), lab.alias("label"))


@query("rcp14_feature_vector", f"""WITH {IND} SELECT receipt_id, score / 100.0::DOUBLE AS f_forgery_score_heuristic, valid::INT::DOUBLE AS f_utr_valid,
  length(nutr)::DOUBLE AS f_utr_length, hotspot_ratio AS f_ela_tamper_regions, font_consistent::INT::DOUBLE AS f_font_consistent,
  color_authentic::INT::DOUBLE AS f_color_authentic, ocr_confidence / 100 AS f_ocr_confidence,
  CASE app WHEN 'PhonePe' THEN 0 WHEN 'GPay' THEN 1 WHEN 'Paytm' THEN 2 ELSE 3 END::DOUBLE AS f_app_detected_encoded FROM ver""")
def rcp14(d: Data):
    out = ops.feature_vector(_scored(d))
    return out.select("receipt_id", *[c for c in out.columns if c.startswith("f_")])


@query("rcp15_ocr_features", r"""WITH b AS (SELECT *, lower(ocr_text) AS low, regexp_extract(ocr_text, '\b([a-zA-Z0-9]{10,18})\b', 1) AS ref FROM {receipts}), w AS (
  SELECT *, position(lower(ref) IN low) AS at_ FROM b)
  SELECT receipt_id, length(ocr_text)::DOUBLE AS ocr_length, len(list_filter(regexp_split_to_array(ocr_text, '\s+'), lambda x: x <> ''))::DOUBLE AS ocr_words,
  length(regexp_replace(ocr_text, '\D', '', 'g'))::DOUBLE AS ocr_digits, (length(low) - length(replace(low, '@', '')))::DOUBLE AS ocr_handles,
  CASE WHEN ocr_text = '' THEN 0 ELSE len(regexp_extract_all(low, '₹')) + len(regexp_extract_all(low, 'rs\.')) + len(regexp_extract_all(low, 'inr')) + len(regexp_extract_all(low, '\d{1,3}(?:,\d{2,3})+(?:\.\d{2})?')) END::DOUBLE AS ocr_amounts,
  len(regexp_extract_all(low, '\d{1,2}[/-]\d{1,2}[/-]\d{2,4}'))::DOUBLE AS ocr_dates,
  (ref <> '')::INT::DOUBLE AS utr_present, length(ref)::DOUBLE AS utr_length, regexp_matches(ref, '^\d{12}$')::INT::DOUBLE AS utr_twelve_digits,
  (ref <> '' AND ((position('utr' IN low) > 0 AND position('utr' IN low) <= at_ + 5) OR (position('ref' IN low) > 0 AND position('ref' IN low) <= at_ + 5)
    OR (position('txn' IN low) > 0 AND position('txn' IN low) <= at_ + 5) OR (position('transaction id' IN low) > 0 AND position('transaction id' IN low) <= at_ + 5)))::INT::DOUBLE AS utr_labelled,
  CASE WHEN ocr_text = '' THEN 0 ELSE coalesce(ocr_confidence, 0) END::DOUBLE AS ocr_confidence_value, 0::DOUBLE AS ocr_low_conf_ratio,
  contains(low, 'paid to')::INT::DOUBLE AS has_paid_to, contains(low, 'received by')::INT::DOUBLE AS has_received_by, contains(low, 'successful')::INT::DOUBLE AS has_successful,
  (contains(ocr_text, '₹') OR contains(low, 'rs.'))::INT::DOUBLE AS has_currency, regexp_matches(ref, '^T\d+$')::INT::DOUBLE AS utr_t_form,
  (regexp_matches(ref, '[a-zA-Z]') AND regexp_matches(ref, '\d'))::INT::DOUBLE AS utr_mixed, (ref <> '')::INT::DOUBLE AS utr_length_ok, (ref <> '')::INT::DOUBLE AS utr_likely_real FROM w""")
def rcp15(d: Data):
    t = F.col("ocr_text")
    rows = pin(d.receipts, {"ref": F.regexp_extract(t, r"\b([a-zA-Z0-9]{10,18})\b", 1)})
    cols = {**R.ocr_features(t, F.col("ocr_confidence")), **R.utr_features(t, F.col("ref"))}
    return rows.select("receipt_id", *[c.alias(k) for k, c in cols.items()])


@query("rcp16_baseline_features", r"""WITH b AS (SELECT *, lower(ocr_text) AS low FROM {receipts})
  SELECT receipt_id, (regexp_matches(ocr_text, '\b\d{12}\b') OR contains(low, 'utr') OR contains(low, 'txn'))::INT::DOUBLE AS utr_extracted,
  regexp_matches(low, '(?:rs\.?|inr|₹)\s?\d+')::INT::DOUBLE AS amount_extracted,
  (contains(low, 'paid to') OR contains(low, 'to:') OR contains(low, 'transfer to') OR contains(low, 'payment to') OR contains(low, '@upi') OR contains(low, '@ok') OR contains(low, 'upi id'))::INT::DOUBLE AS recipient_extracted,
  regexp_matches(ocr_text, '\b\d{12}\b')::INT::DOUBLE AS utr_format_valid, regexp_matches(ocr_text, '\b\d+(?:\.\d{2})?\b')::INT::DOUBLE AS amount_format_valid,
  ocr_confidence AS ocr_confidence_value FROM b""")
def rcp16(d: Data):
    cols = R.baseline_ocr_features(F.col("ocr_text"), F.col("ocr_confidence"))
    return d.receipts.select("receipt_id", *[c.alias(n) for n, c in cols.items()])


@query("rcp17_visual_fusion", """WITH p AS (SELECT receipt_id, CASE WHEN NOT color_authentic THEN 100 ELSE least(100, color_distance * 400) END::DOUBLE AS cp,
  CASE WHEN NOT font_consistent THEN 100 ELSE least(100, height_variance * 800) END::DOUBLE AS fp,
  CASE WHEN tamper_suspected THEN greatest(ela_score, hotspot_ratio * 100, 60) ELSE ela_score END::DOUBLE AS ep,
  CASE WHEN visual_verdict = 'FORGED' THEN greatest(70, visual_confidence) WHEN coalesce(visual_verdict, 'SUSPICIOUS') = 'SUSPICIOUS' THEN visual_confidence ELSE least(30, 100 - visual_confidence) END::DOUBLE AS vp FROM {receipts}), e AS (
  SELECT *, greatest(0, least(100, cp * 0.2::DOUBLE + fp * 0.2::DOUBLE + ep * 0.2::DOUBLE + vp * 0.4::DOUBLE)) AS es FROM p)
  SELECT receipt_id, round(cp, 6) AS color_part, round(fp, 6) AS font_part, round(ep, 6) AS ela_part, round(vp, 6) AS visual_part, round(es, 6) AS enhanced_score,
  CASE WHEN round(es, 9) >= 60 THEN 'LIKELY_FORGED' WHEN round(es, 9) >= 30 THEN 'SUSPICIOUS' ELSE 'GENUINE' END AS enhanced_verdict FROM e""")
def rcp17(d: Data):
    cols = R.visual_fusion(*[F.col(c) for c in (
        "color_authentic", "color_distance", "font_consistent", "height_variance", "tamper_suspected", "ela_score",
        "hotspot_ratio", "visual_verdict", "visual_confidence")])
    out = pin(d.receipts.select("receipt_id", *[c for c in d.receipts.columns if c != "receipt_id"]), cols)
    return out.select(
        "receipt_id", *[F.round(n, 6).alias(n) for n in cols],
        L.receipt_verdict(F.round("enhanced_score", 9)).alias("enhanced_verdict"))


_RGB = "receipt_id * 7 % 256 AS r1, receipt_id * 11 % 256 AS g1, receipt_id * 13 % 256 AS b1, payer * 3 % 256 AS r2, payer * 5 % 256 AS g2, payer * 17 % 256 AS b2"


def _dist(r, g, b):
    a, b2 = [f"sqrt((r{i}-{r})*(r{i}-{r})+(g{i}-{g})*(g{i}-{g})+(b{i}-{b})*(b{i}-{b}))" for i in (1, 2)]
    return f"least({a}, {b2})"


_ANY = " ".join(f"WHEN '{a}' THEN least({', '.join(_dist(*c) for c in p)})" for a, p in R.PALETTES.items())
_FIRST = " ".join(f"WHEN '{a}' THEN {_dist(*p[0])}" for a, p in R.PALETTES.items())


@query("rcp18_palette_check", f"""WITH x AS (SELECT receipt_id, app, {_RGB} FROM {{receipts}}), y AS (SELECT receipt_id, CASE app {_ANY} END AS dist, CASE app {_FIRST} END AS first FROM x), z AS (
  SELECT *, dist IS NULL OR (dist <= 85 AND first <= 85) AS ok FROM y)
  SELECT receipt_id, round(dist, 6) AS distance, ok AS color_ok, round(CASE WHEN dist IS NULL THEN 0.5 WHEN ok THEN least(0.98, 0.95 - dist / 85 * 0.30) ELSE least(0.95, 0.40 + dist / 440 * 0.40) END, 6) AS color_confidence FROM z""")
def rcp18(d: Data):
    rows = d.receipts.selectExpr("receipt_id", "app", *_RGB.split(", ")).withColumn("rgbs", F.array(*[
        F.struct(F.col(f"r{i}").alias("r"), F.col(f"g{i}").alias("g"), F.col(f"b{i}").alias("b")) for i in (1, 2)]))
    out = ops.color_check(rows)
    return out.select("receipt_id", F.round("distance", 6).alias("distance"), "color_ok",
                      F.round("color_confidence", 6).alias("color_confidence"))


_PIX = ("SELECT l_suppkey AS image_id, CAST(l_partkey * 7 % 256 AS INT) AS r, CAST(l_orderkey * 3 % 256 AS INT) AS g, "
        "CAST(l_linenumber * 40 % 256 AS INT) AS b FROM {lineitem}")


@query("rcp19_dominant_colors", f"""WITH px AS ({_PIX}), q AS (SELECT image_id, least(255, r // 32 * 32 + 16) AS r, least(255, g // 32 * 32 + 16) AS g, least(255, b // 32 * 32 + 16) AS b, count(*) AS n FROM px GROUP BY ALL), k AS (
  SELECT *, round_even(n / sum(n) OVER (PARTITION BY image_id), 4) AS pct, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b)::INT AS rank FROM q)
  SELECT image_id, rank, n, pct, lower(printf('#%02x%02x%02x', r, g, b)) AS hex FROM k WHERE rank <= 5""")
def rcp19(d: Data):
    return ops.dominant_colors(d.sql(_PIX)).select("image_id", "rank", "n", "pct", "hex")


_COMP = ("SELECT l_suppkey AS image_id, CASE l_suppkey % 3 WHEN 0 THEN 'PhonePe' WHEN 1 THEN 'Paytm' ELSE 'BHIM' END AS app, "
         "CAST(l_partkey % 200 AS INT) AS w, CAST((l_orderkey * (l_suppkey % 5 + 1)) % 55 AS INT) AS h FROM {lineitem}")


@query("rcp20_font_variance", f"""WITH c AS ({_COMP}), s AS (SELECT image_id, app, count(*) AS n, var_pop(h) AS v FROM c WHERE h BETWEEN 6 AND 45 AND w BETWEEN 3 AND 180 GROUP BY ALL), t AS (
  SELECT *, n < 8 OR v <= CASE WHEN app = 'PhonePe' THEN 160 ELSE 110 END AS ok FROM s)
  SELECT image_id, app, n AS component_count, round(CASE WHEN n < 8 THEN 0 ELSE v END, 4) AS height_variance, ok AS font_ok,
  round(CASE WHEN n < 8 THEN 0.6 WHEN ok THEN least(0.95, 0.90 - v / 200 * 0.15) ELSE least(0.95, 0.50 + v / 400 * 0.35) END, 4) AS font_confidence FROM t""")
def rcp20(d: Data):
    return ops.font_check(d.sql(_COMP))


@query("rcp21_ela_rules", """WITH s AS (SELECT receipt_id, payer, CASE WHEN hotspot_ratio > 0.12 OR mean_diff > 8 THEN 35 WHEN hotspot_ratio > 0.06 OR mean_diff > 4 THEN 15 ELSE 0 END AS shot,
  CASE WHEN hotspot_ratio > 0.15 THEN 30 WHEN hotspot_ratio > 0.08 THEN 10 ELSE 0 END AS page, hotspot_ratio > 0.08 OR mean_diff > 8 AS susp FROM {receipts})
  SELECT payer AS doc_id, max(page) AS ela_points, count(*) FILTER (susp) AS suspicious_pages, count(*) AS pages_analyzed, sum(shot)::BIGINT AS screenshot_points, count(*) FILTER (shot > 0) AS screenshots_suspected FROM s GROUP BY payer""")
def rcp21(d: Data):
    rows = ops.ela_screen(d.receipts.withColumn("doc_id", F.col("payer")))
    shots = rows.groupBy("doc_id").agg(
        F.sum("ela_points").alias("screenshot_points"), F.count_if("ela_suspected").alias("screenshots_suspected"))
    return ops.ela_pages(rows).join(shots, "doc_id")


@query("rcp22_fallback_report", f"""WITH {CAND}, a AS (SELECT receipt_id, utr, {AMT} AS amount FROM utr1), s AS (
  SELECT receipt_id, CASE WHEN length(coalesce(utr, '')) <> 12 THEN 65 WHEN coalesce(amount, 0) < 50000 THEN 15 ELSE 45 END AS risk_score FROM a)
  SELECT receipt_id, risk_score, CASE WHEN risk_score < 30 THEN 'CLEAN' WHEN risk_score < 60 THEN 'SUSPICIOUS' ELSE 'HIGH' END AS risk_level FROM s""")
def rcp22(d: Data):
    s = R.fallback_score(F.col("utr"), F.coalesce(F.col("amount"), F.lit(0.0)))
    return _parsed(d).select("receipt_id", s.alias("risk_score")).withColumn("risk_level", L.adapter_level(F.col("risk_score")))


@query("rcp23_event_rows", f"""WITH {IND} SELECT receipt_id AS id, seen_at AS timestamp, 'screenshot' AS event_type, utr AS utr_number, vpas[1] AS sender_upi_id,
  {_payee(R.PAYEE_LABELS, 'vpas[-1]')} AS receiver_upi_id, {AMT} AS amount, valid::INT AS is_valid_utr, (NOT font_consistent)::INT AS font_anomalies_detected,
  list_contains(rules, 'suspicious_keywords')::INT AS suspicious_handle_flagged, score AS risk_score, verdict AS risk_level, len(points)::INT AS explanation_lines FROM ver""")
def rcp23(d: Data):
    out = ops.event_rows(_scored(d))
    lines = F.when(F.col("explanation").startswith("- "), F.size(F.split("explanation", "\n"))).otherwise(0)
    return out.withColumn("explanation_lines", lines).drop("explanation", "metadata_json")


@query("fil5_receipt_gate", f"WITH {CAND} SELECT receipt_id, {GATE} AS is_receipt FROM raw")
def fil5(d: Data):
    return d.receipts.select("receipt_id", R.is_receipt(F.col("ocr_text")).alias("is_receipt"))
