"""Dashboard, filter and projection queries."""

from pyspark.sql import functions as F

from ..functions.exprs import hit_rules
from ..operators import dashboards as ops
from ..operators import receipts as rops
from .receipts import IND
from . import inputs  # noqa: F401
from .registry import Data, query

LEVEL = "CASE WHEN risk_level IN ('CRITICAL', 'HIGH', 'SUSPICIOUS') THEN risk_level ELSE 'CLEAN' END"
EXPLODED = "ind AS (SELECT event_id, unnest(string_split(indicator_list, '|')) AS indicator FROM {fraud_events}), ic AS (SELECT indicator, count(*) AS n FROM ind WHERE indicator <> '' GROUP BY 1)"


def events(d: Data):
    return ops.event_arrays(d.fraud_events)


@query("agg1_store_statistics", f"""SELECT count(*) AS total_events, count(*) FILTER (source_type = 'DOCUMENT') AS document_events, count(*) FILTER (source_type = 'URL') AS url_events,
  count(*) FILTER ({LEVEL} = 'CLEAN') AS clean_count, count(*) FILTER ({LEVEL} = 'SUSPICIOUS') AS suspicious_count, count(*) FILTER ({LEVEL} = 'HIGH') AS high_risk_count,
  count(*) FILTER ({LEVEL} = 'CRITICAL') AS critical_count, round_even(sum(risk_score) / count(*), 2) AS average_risk_score FROM {{fraud_events}}""")
def agg1(d: Data):
    return ops.store_statistics(d.fraud_events)


@query("agg1_top_indicators", f"WITH {EXPLODED} SELECT indicator, n FROM ic ORDER BY n DESC, indicator LIMIT 10")
def agg1_top(d: Data):
    return ops.indicator_frequency(events(d), 10)


@query("agg2_recent_events", "SELECT event_id, source_type, risk_score, created_at FROM {fraud_events} ORDER BY created_at DESC, event_id DESC LIMIT 20")
def agg2(d: Data):
    return ops.recent_events(d.fraud_events).select("event_id", "source_type", "risk_score", "created_at")


@query("agg3_risk_distribution", f"SELECT k.risk_level, count(e.lvl) AS n FROM (VALUES ('CLEAN'), ('SUSPICIOUS'), ('HIGH'), ('CRITICAL')) k(risk_level) LEFT JOIN (SELECT {LEVEL} AS lvl FROM {{fraud_events}}) e ON e.lvl = k.risk_level GROUP BY 1")
def agg3(d: Data):
    return ops.risk_distribution(d.fraud_events)


@query("agg4_indicator_frequency", f"WITH {EXPLODED} SELECT indicator, n FROM ic ORDER BY n DESC, indicator LIMIT 20")
def agg4(d: Data):
    return ops.indicator_frequency(events(d))


@query("agg5_timeline", """SELECT c.day::DATE AS day, count(e.source_type) FILTER (e.source_type = 'URL') AS phishing, count(e.source_type) FILTER (e.source_type = 'DOCUMENT') AS documents,
  count(e.source_type) FILTER (e.source_type IN ('URL', 'DOCUMENT')) AS total
  FROM (SELECT unnest(generate_series(DATE '2024-01-28', DATE '2024-02-03', INTERVAL 1 DAY)) AS day) c LEFT JOIN {fraud_events} e ON e.created_at::DATE = c.day GROUP BY 1""")
def agg5(d: Data):
    return ops.timeline(d.fraud_events, F.to_date(F.lit("2024-02-03")), 7)


@query("agg6_session_counters", "SELECT count(*) AS total, count(*) FILTER (severity IN ('critical', 'high')) AS urgent FROM {alerts}")
def agg6(d: Data):
    return ops.session_counters(d.alerts.withColumn("threat_level", F.upper("severity")))


@query("agg7_replay_feed", f"""WITH {IND}, a AS (SELECT 'alert-' || id AS event_id, ts, CASE WHEN indicator_type IN ('domain', 'ip') THEN 'phish' ELSE 'upi' END AS module, upper(severity) AS threat_level,
  coalesce(description, 'Alert on ' || value) AS summary, CASE severity WHEN 'critical' THEN 85 WHEN 'high' THEN 65 ELSE 45 END AS risk_score,
  CASE WHEN indicator_type IN ('domain', 'ip') THEN 'PHISHING' ELSE 'FRAUD' END AS ai_verdict, indicator_type AS indicator FROM (SELECT * FROM {{alerts}} ORDER BY ts DESC, id DESC LIMIT 50)),
  r AS (SELECT 'upi-' || receipt_id AS event_id, seen_at AS ts, 'upi' AS module, verdict AS threat_level, 'Receipt check' AS summary, CASE WHEN score = 0 THEN 50 ELSE score END AS risk_score,
  'CLEAN' AS ai_verdict, CASE WHEN NOT font_consistent THEN 'font_anomaly' ELSE 'utr_check' END AS indicator FROM (SELECT * FROM ver ORDER BY seen_at DESC, receipt_id DESC LIMIT 50))
  SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM r) ORDER BY ts DESC, event_id DESC LIMIT 50""")
def agg7(d: Data):
    # Take the latest receipts before parsing and scoring them, not after.
    latest = d.receipts.orderBy(F.desc("seen_at"), F.desc("receipt_id")).limit(50)
    return ops.replay_feed(d.alerts, rops.event_rows(rops.score(rops.parse(latest))))


_DIMS = ["split", "label", "app", "forgery_type", "difficulty"]


@query("agg8_dataset_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS dimension, coalesce({c}::VARCHAR, 'None') AS value, count(*) AS n FROM {{receipt_features}} GROUP BY 2" for c in _DIMS))
def agg8(d: Data):
    return ops.marginal_counts(d.receipt_features, *_DIMS)


_FEATS = ["brand_palette_distance", "text_height_variance", "ela_hotspot_density"]


@query("agg9_class_separation", " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, round(avg({f}) FILTER (label = 0), 9) AS genuine_mean, round(stddev_samp({f}) FILTER (label = 0), 9) AS genuine_std, round(avg({f}) FILTER (label = 1), 9) AS forged_mean,
  round(stddev_samp({f}) FILTER (label = 1), 9) AS forged_std, round((avg({f}) FILTER (label = 1) - avg({f}) FILTER (label = 0)) / sqrt(0.5 * (var_samp({f}) FILTER (label = 1) + var_samp({f}) FILTER (label = 0))), 9) AS separation FROM {{receipt_features}}"""
    for f in _FEATS))
def agg9(d: Data):
    out = ops.class_separation(d.receipt_features, _FEATS)
    return out.select("feature", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query("agg10_manifest_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS dimension, coalesce({c}::VARCHAR, 'None') AS value, count(*) AS n FROM {{records}} GROUP BY 2" for c in ("split", "dataset_type", "source")))
def agg10(d: Data):
    return ops.marginal_counts(d.records, "split", "dataset_type", "source")


@query("agg10_registry_checks", """WITH x AS (SELECT id, path_or_value, dataset_type, count(*) OVER (PARTITION BY id) AS k FROM {records})
  SELECT dataset_type AS module, count(*) AS experiments, count(*) FILTER (k > 1) AS duplicate_ids, count(*) FILTER (trim(path_or_value) = '') AS blank_paths FROM x GROUP BY 1""")
def agg10_registry(d: Data):
    from ..sources.manifests import registry_checks
    return registry_checks(d.records.withColumnRenamed("dataset_type", "module"), "id", "path_or_value")


@query("dna10_threat_summary", """SELECT count(*) AS total_events, count(*) FILTER (risk_level = 'HIGH') AS high_risk_count, count(*) FILTER (risk_level = 'SUSPICIOUS') AS suspicious_count,
  CASE WHEN count(*) FILTER (risk_level = 'HIGH') / count(*) > 0.4 THEN 'CRITICAL' WHEN count(*) FILTER (risk_level IN ('HIGH', 'SUSPICIOUS')) / count(*) > 0.5 THEN 'ELEVATED' ELSE 'NORMAL' END AS threat_level FROM {fraud_events}""")
def dna10(d: Data):
    return ops.threat_summary(d.fraud_events)


@query("dna10_top_risks", f"WITH {EXPLODED} SELECT indicator, n FROM ic ORDER BY n DESC, indicator LIMIT 5")
def dna10_top(d: Data):
    return ops.indicator_frequency(events(d), 5)


@query("fil1_alert_filter", "SELECT id, ts, value FROM {alerts} WHERE severity = 'critical' AND indicator_type = 'domain'")
def fil1(d: Data):
    return ops.filter_alerts(d.alerts, "critical", "domain").select("id", "ts", "value")


@query("fil2_event_search", "SELECT event_id, original_filename FROM {fraud_events} WHERE contains(lower(coalesce(original_filename, source_domain, '')), 'invoice_1') AND source_type = 'DOCUMENT' AND risk_level = 'HIGH'")
def fil2(d: Data):
    return ops.search_events(d.fraud_events, "INVOICE_1", "DOCUMENT", "HIGH").select("event_id", "original_filename")


@query("fil3_text_search", """(SELECT 'Case' AS kind, id, title, status, severity, NULL AS indicator_type, NULL AS value, NULL AS description FROM {cases} WHERE title ILIKE '%campaign 7%' OR description ILIKE '%campaign 7%' OR notes ILIKE '%campaign 7%' ORDER BY id LIMIT 5)
  UNION ALL (SELECT 'ThreatAlert', id, NULL, NULL, severity, indicator_type, value, description FROM {alerts} WHERE value ILIKE '%campaign 7%' OR description ILIKE '%campaign 7%' ORDER BY id LIMIT 5)""")
def fil3(d: Data):
    return ops.search_cases_and_alerts(d.cases, d.alerts, "CAMPAIGN 7")


@query("fil4_module_routing", """SELECT CASE WHEN has_fusion_key THEN 'fusion' WHEN dataset_type = 'URL' THEN 'url' WHEN dataset_type = 'DOCUMENT' THEN 'document' ELSE 'upi' END AS module, count(*) AS n FROM {records} GROUP BY 1""")
def fil4(d: Data):
    from ..sources.manifests import route
    recs = d.records.withColumn("metadata", F.when(
        F.col("has_fusion_key"), F.create_map(F.lit("upi_result"), F.lit("{}"))).otherwise(F.create_map(F.lit("note"), F.col("meta_note"))))
    return route(recs).groupBy("module").agg(F.count("*").alias("n"))


@query("prj1_slim_events", """SELECT event_id, doc_id, source_type, coalesce(original_filename, source_domain, event_id) AS label, risk_score, coalesce(risk_level, 'CLEAN') AS risk_level, created_at FROM {fraud_events}""")
def prj1(d: Data):
    return ops.slim_events(d.fraud_events)
