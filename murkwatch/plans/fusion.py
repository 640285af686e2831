"""Fusion and contribution queries."""

from pyspark.sql import functions as F

from ..functions.exprs import hit_rules
from ..operators import fusion as ops
from . import inputs  # noqa: F401
from .registry import Data, define_input, query

define_input("case_scores", """
SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey * 37 % 130 - 10 AS DOUBLE) END AS document,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey * 53 % 101 AS DOUBLE) END AS phishing,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST((o_orderkey + o_custkey) * 29 % 101 AS DOUBLE) END AS upi,
       CASE WHEN o_orderkey % 7 = 0 THEN 'see http link' ELSE 'plain' END AS doc_text, o_orderkey % 11 = 0 AS has_campaign
FROM {orders}
""")
CLIP = "c AS (SELECT *, CASE WHEN document IS NOT NULL THEN greatest(0, least(100, document)) END AS dd, phishing AS pp, upi AS uu FROM {case_scores}), w AS (" \
    "SELECT *, CASE WHEN dd IS NULL THEN 0 ELSE 0.35::DOUBLE END AS wd, CASE WHEN pp IS NULL THEN 0 ELSE 0.35::DOUBLE END AS wp, CASE WHEN uu IS NULL THEN 0 ELSE 0.3::DOUBLE END AS wu FROM c), t AS (" \
    "SELECT *, wd + wp + wu AS tw FROM w), f AS (SELECT *, CASE WHEN tw = 0 THEN 0 ELSE wd / tw END AS document_weight, CASE WHEN tw = 0 THEN 0 ELSE wp / tw END AS phishing_weight, CASE WHEN tw = 0 THEN 0 ELSE wu / tw END AS upi_weight FROM t), g AS (" \
    "SELECT *, round_even(round(coalesce(dd, 0) * document_weight + coalesce(pp, 0) * phishing_weight + coalesce(uu, 0) * upi_weight, 9), 0)::INT AS unified_score FROM f)"


@query("fus1_extract_score", """SELECT case_id, CASE WHEN s IS NOT NULL THEN greatest(0, least(100, s)) END AS score FROM (SELECT case_id, CASE case_id % 4 WHEN 0 THEN document WHEN 1 THEN phishing WHEN 2 THEN upi END AS s FROM {case_scores})""")
def fus1(d: Data):
    js = F.expr("CASE case_id % 4 WHEN 0 THEN to_json(named_struct('risk_score', document)) WHEN 1 THEN to_json(named_struct('risk_score', 'n/a', 'forgery_score', phishing)) "
                "WHEN 2 THEN to_json(named_struct('unified_score', upi)) ELSE '{}' END")
    return d.case_scores.select("case_id", ops.extract_score(js).alias("score"))


@query("fus2_weights", f"WITH {CLIP} SELECT case_id, round(document_weight, 9) AS document_weight, round(phishing_weight, 9) AS phishing_weight, round(upi_weight, 9) AS upi_weight FROM f")
def fus2(d: Data):
    return ops.fuse(d.case_scores).select("case_id", *[F.round(f"{m}_weight", 9).alias(f"{m}_weight") for m in ops.WEIGHTS])


@query("fus3_unified_score", f"WITH {CLIP} SELECT case_id, unified_score, CASE WHEN unified_score < 25 THEN 'CLEAN' WHEN unified_score < 50 THEN 'LOW' WHEN unified_score < 70 THEN 'SUSPICIOUS' WHEN unified_score < 90 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level FROM g WHERE dd IS NOT NULL OR pp IS NOT NULL OR uu IS NOT NULL")
def fus3(d: Data):
    side = lambda m: d.case_scores.where(F.col(m).isNotNull()).select("case_id", F.col(m).alias("score"))
    return ops.fuse(ops.align(side("document"), side("phishing"), side("upi"))).select("case_id", "unified_score", "risk_level")


@query("fus4_dominant_signal", f"""WITH {CLIP}, m AS (SELECT *, greatest(coalesce(dd, 0), coalesce(pp, 0), coalesce(uu, 0)) AS top FROM g)
  SELECT dominant_signal, count(*) AS n FROM (SELECT CASE WHEN top > 0 THEN CASE WHEN dd = top THEN 'document' WHEN pp = top THEN 'phishing' ELSE 'upi' END END AS dominant_signal FROM m) GROUP BY 1""")
def fus4(d: Data):
    return ops.fuse(d.case_scores).groupBy("dominant_signal").agg(F.count("*").alias("n"))


@query("fus5_correlation_flags", f"""WITH {CLIP} SELECT case_id, array_to_string(list_filter([
  CASE WHEN (coalesce(dd, 0) >= 70)::INT + (coalesce(pp, 0) >= 70)::INT + (coalesce(uu, 0) >= 70)::INT >= 2 THEN 'shared_high_risk' END,
  CASE WHEN contains(doc_text, 'http') AND pp >= 50 THEN 'doc_url_alignment' END, CASE WHEN uu >= 50 AND pp >= 50 THEN 'payment_fraud_alignment' END,
  CASE WHEN has_campaign THEN 'campaign_escalation' END], lambda x: x IS NOT NULL), '|') AS flags FROM g""")
def fus5(d: Data):
    rows = ops.fuse(d.case_scores).withColumn("doc_rules", F.lit(None).cast("array<string>"))
    return ops.correlation_flags(rows).select("case_id", F.array_join(hit_rules("correlation_flags"), "|").alias("flags"))


_ITEMS = "[{'rule': 'http_only', 's': 20}, {'rule': 'ip_as-domain', 's': case_id % 50}, {'rule': 'trusted_site', 's': -(case_id % 20)}]"


@query("fus6_contributions", """WITH i AS (SELECT case_id, unnest(['http_only', 'ip_as-domain', 'trusted_site']) AS rule, unnest([20, case_id % 50, -(case_id % 20)])::DOUBLE AS raw_score, unnest([0, 1, 2]) AS pos FROM {case_scores}), s AS (
  SELECT *, round_even(abs(raw_score) / sum(abs(raw_score)) OVER (PARTITION BY case_id) * 100, 2) AS contribution_pct FROM i)
  SELECT case_id, CASE rule WHEN 'http_only' THEN 'Http Only' WHEN 'ip_as-domain' THEN 'Ip As Domain' ELSE 'Trusted Site' END AS name, raw_score + 0 AS raw_score, contribution_pct,
  CASE WHEN raw_score > 0 THEN 'risk_increasing' WHEN raw_score < 0 THEN 'risk_decreasing' ELSE 'neutral' END AS direction,
  row_number() OVER (PARTITION BY case_id ORDER BY contribution_pct DESC, pos)::INT AS rank FROM s""")
def fus6(d: Data):
    ind = F.expr("array(named_struct('rule', 'http_only', 'score', 20L), named_struct('rule', 'ip_as-domain', 'score', case_id % 50), named_struct('rule', 'trusted_site', 'score', -(case_id % 20)))")
    return ops.indicator_contributions(d.case_scores.withColumn("indicators", ind), "case_id")


@query("fus7_feature_contributions", """WITH i AS (SELECT case_id, unnest(['Has Campaign', 'Phishing', 'Doc Level']) AS name, unnest([CASE WHEN has_campaign THEN 40 ELSE 0 END, coalesce(phishing, 0) * 0.5, CASE case_id % 3 WHEN 0 THEN 50 WHEN 1 THEN -20 ELSE 0 END])::DOUBLE AS raw_score, unnest([0, 1, 2]) AS pos FROM {case_scores}), t AS (
  SELECT *, sum(abs(raw_score)) OVER (PARTITION BY case_id) AS total FROM i), s AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE round_even(abs(raw_score) / total * 100, 2) END AS contribution_pct FROM t)
  SELECT case_id, name, raw_score, contribution_pct, CASE WHEN raw_score > 0 THEN 'risk_increasing' WHEN raw_score < 0 THEN 'risk_decreasing' ELSE 'neutral' END AS direction,
  row_number() OVER (PARTITION BY case_id ORDER BY contribution_pct DESC, pos)::INT AS rank FROM s""")
def fus7(d: Data):
    rows = d.case_scores.withColumn("doc_level", F.expr("CASE case_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'safe' ELSE 'odd' END"))
    return ops.feature_contributions(rows, "case_id", {"has_campaign": "bool", "phishing": "number", "doc_level": "level"}, {"phishing": 0.5})


_COEF = {"brand_palette_distance": 2.5, "text_height_variance": 1.5, "utr_valid": -3.0, "ocr_confidence": -0.5}
_LONG = " UNION ALL ".join(
    f"SELECT id, '{c}' AS feature, {c} AS value, {w}::DOUBLE * ({c} - (SELECT avg({c}) FROM {{receipt_features}})) AS contribution FROM {{receipt_features}}" for c, w in _COEF.items())


@query("fus8_linear_contributions", f"SELECT id, feature, value, round(contribution, 9) AS contribution FROM ({_LONG})")
def fus8(d: Data):
    out = ops.linear_contributions(d.receipt_features, "id", _COEF)
    return out.select("id", "feature", "value", F.round("contribution", 9).alias("contribution"))


@query("fus9_global_importance", f"""SELECT feature, mean_abs, CASE WHEN c >= 0 THEN 'positive' ELSE 'negative' END AS direction, row_number() OVER (ORDER BY mean_abs DESC, feature)::INT AS rank
  FROM (SELECT feature, round_even(avg(abs(contribution)), 5) AS mean_abs, corr(value, contribution) AS c FROM ({_LONG}) GROUP BY 1)""")
def fus9(d: Data):
    return ops.global_importance(ops.linear_contributions(d.receipt_features, "id", _COEF))
