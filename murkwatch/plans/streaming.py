"""Batch forms of the streaming operators."""

from pyspark.sql import functions as F

from ..session import bounded_stream, cut_lineage, shared_folder
from ..streaming import drift, feed
from . import inputs  # noqa: F401
from .registry import Data, define_input, query

define_input("detections", """
SELECT event_id, created_at AS ts, CASE CAST(substr(event_id, 13, 1) AS INT) % 5 WHEN 0 THEN 'phish' WHEN 1 THEN 'doc' WHEN 2 THEN 'upi' WHEN 3 THEN 'fraud_dna' ELSE 'other' END AS module,
       risk_score, CASE WHEN user_id % 13 = 0 THEN 'odd' ELSE risk_level END AS risk_level, CASE WHEN user_id % 4 = 0 THEN CAST(user_id % 101 AS INT) ELSE NULL END AS ai_score,
       CASE WHEN user_id % 8 = 0 THEN 'medium_risk' ELSE NULL END AS ai_level, CASE WHEN user_id % 3 = 0 THEN 'benign' ELSE NULL END AS ai_verdict,
       coalesce(original_filename, source_domain) AS subject, indicator_list, user_id
FROM {fraud_events}
""")


@query("str1_threat_events", """WITH s AS (SELECT *, CASE WHEN ai_score IS NOT NULL THEN ai_score ELSE coalesce(risk_score, 50) END AS sc, upper(CASE WHEN ai_score IS NOT NULL THEN coalesce(ai_level, risk_level, 'MEDIUM') ELSE coalesce(risk_level, 'MEDIUM') END) AS lv FROM {detections})
  SELECT event_id, module, CASE WHEN lv IN ('CLEAN', 'LOW_RISK', 'LOW') THEN 'LOW' WHEN lv IN ('SUSPICIOUS', 'MEDIUM_RISK', 'MEDIUM') THEN 'MEDIUM' WHEN lv IN ('HIGH', 'HIGH_RISK') THEN 'HIGH' WHEN lv IN ('CRITICAL', 'CRITICAL_RISK') THEN 'CRITICAL'
    WHEN sc >= 81 THEN 'CRITICAL' WHEN sc >= 61 THEN 'HIGH' WHEN sc >= 31 THEN 'MEDIUM' ELSE 'LOW' END AS threat_level, sc AS risk_score,
  CASE module WHEN 'phish' THEN 'Bait link for ' || coalesce(subject, 'an unnamed host') WHEN 'doc' THEN 'Altered metadata: ' || coalesce(subject, 'unnamed file')
    WHEN 'upi' THEN 'Receipt checked, amount ' || coalesce(subject, '0.0') || ' INR' WHEN 'fraud_dna' THEN 'Event joins a known campaign' ELSE 'Signal from ' || module END AS summary,
  upper(coalesce(ai_verdict, CASE module WHEN 'phish' THEN 'PHISHING' WHEN 'doc' THEN 'TAMPERED' WHEN 'other' THEN 'UNKNOWN' ELSE 'FRAUD' END)) AS ai_verdict,
  CASE WHEN indicator_list = '' THEN 'unspecified' ELSE indicator_list END AS indicators FROM s""")
def str1(d: Data):
    rules = F.filter(F.split("indicator_list", r"\|"), lambda x: x != "")
    none = F.lit(None).cast("array<string>")
    rows = d.detections.withColumns({
        "triggered_rules": F.when(F.col("user_id") % 2 == 0, rules), "indicators": none, "risk_indicators": rules,
        "drift_status": F.lit(None).cast("string")})
    out = feed.threat_events(rows)
    return out.select("event_id", "module", "threat_level", "risk_score", "summary", "ai_verdict",
                      F.array_join("indicators", "|").alias("indicators"))


@query("str2_windowed_counts", """SELECT date_trunc('day', created_at) AS start, source_type, count(*) AS n, count(*) FILTER (risk_level IN ('CRITICAL', 'HIGH')) AS urgent FROM {fraud_events} GROUP BY ALL""")
def str2(d: Data):
    out = feed.windowed_counts(d.fraud_events.withColumnRenamed("created_at", "ts"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


NUM = """nm AS (SELECT *, row_number() OVER w AS n, sum(error) OVER (PARTITION BY module ORDER BY ts, event_id) AS te FROM {error_stream} WINDOW w AS (PARTITION BY module ORDER BY ts, event_id))"""
DDM = NUM + """, dd AS (SELECT *, te / n::DOUBLE AS p, sqrt(te / n::DOUBLE * (1 - te / n::DOUBLE) / n) AS s FROM nm), dm AS (
  SELECT *, min(CASE WHEN n >= 30 AND te > 0 THEN {'l': p + s, 'p': p, 's': s} END) OVER (PARTITION BY module ORDER BY n) AS best FROM dd), df AS (
  SELECT *, coalesce(n >= 30 AND p + s > best.p + 3 * best.s, false) AS ddm_drift, coalesce(n >= 30 AND p + s > best.p + 2 * best.s, false) AS over_warn FROM dm)"""
PH = NUM + """, pi AS (SELECT *, sum(error - te / n::DOUBLE - 0.005::DOUBLE) OVER (PARTITION BY module ORDER BY n) AS m FROM nm), pp AS (
  SELECT *, n >= 30 AND m - least(0, min(m) OVER (PARTITION BY module ORDER BY n)) > 50 AS ph_drift FROM pi)"""


@query("str3_error_rates", f"""WITH {NUM}, r AS (SELECT module, n, avg(error) OVER (PARTITION BY module ORDER BY n ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) AS cur, avg(CASE WHEN n <= 500 THEN error END) OVER (PARTITION BY module ORDER BY n) AS base FROM nm)
  SELECT module, n, round(cur, 9) AS error_rate_current, round(base, 9) AS error_rate_baseline, round(cur - base, 9) AS delta FROM r""")
def str3(d: Data):
    out = drift.error_rates(d.error_stream)
    return out.select("module", "n", *[F.round(c, 9).alias(c) for c in ("error_rate_current", "error_rate_baseline", "delta")])


@query("str5_ddm", f"WITH {DDM} SELECT module, count(*) FILTER (ddm_drift) AS drift_rows, count(*) FILTER (over_warn AND NOT ddm_drift) AS warning_rows, min(CASE WHEN ddm_drift THEN n END) AS first_drift FROM df GROUP BY 1")
def str5(d: Data):
    out = drift.ddm(drift.numbered(d.error_stream))
    return out.groupBy("module").agg(
        F.count_if("ddm_drift").alias("drift_rows"), F.count_if("ddm_warning").alias("warning_rows"),
        F.min(F.when(F.col("ddm_drift"), F.col("n"))).alias("first_drift"))


@query("str6_page_hinkley", f"WITH {PH} SELECT module, count(*) FILTER (ph_drift) AS drift_rows, min(CASE WHEN ph_drift THEN n END) AS first_drift, round(max(m), 6) AS highest_sum FROM pp GROUP BY 1")
def str6(d: Data):
    out = drift.page_hinkley(drift.numbered(d.error_stream))
    return out.groupBy("module").agg(
        F.count_if("ph_drift").alias("drift_rows"), F.min(F.when(F.col("ph_drift"), F.col("n"))).alias("first_drift"),
        F.round(F.max("ph_sum"), 6).alias("highest_sum"))


ADW = """ce AS (SELECT module, n // 32 AS c, te AS s FROM nm WHERE n % 32 = 0), cu AS (
  SELECT module, c, s, unnest(list_transform(range(0, 63), lambda k: CASE WHEN (1::BIGINT << k) < c THEN 1::BIGINT << k END)) AS tail FROM ce), cm AS (
  SELECT cu.module, cu.c, cu.s, 32 * cu.c AS n, 32 * ce.c AS n0, 32 * tail AS n1, ce.s AS s0 FROM cu JOIN ce ON ce.module = cu.module AND ce.c = cu.c - tail WHERE tail IS NOT NULL), cb AS (
  SELECT *, 1.0::DOUBLE / (n0 - 4) + 1.0::DOUBLE / (n1 - 4) AS iv, s / n::DOUBLE AS p, ln(2.0::DOUBLE * ln(n::DOUBLE) / 0.002::DOUBLE) AS lg FROM cm), aw AS (
  SELECT module, min(n) AS adwin_at FROM cb WHERE abs(s0 / n0::DOUBLE - (s - s0) / n1::DOUBLE) > sqrt(2.0::DOUBLE * iv * p * (1 - p) * lg) + 2.0::DOUBLE / 3 * iv * lg GROUP BY module)"""


@query("str7_adwin", f"WITH {NUM}, {ADW} SELECT module, adwin_at FROM aw")
def str7(d: Data):
    return drift.adwin(drift.numbered(d.error_stream))


def _votes(d: Data):
    return drift.majority_vote(drift.first_votes(drift.numbered(d.error_stream)))


VOTE = DDM + PH[len(NUM):] + f", {ADW}" + """, fv AS (SELECT df.module, df.n, df.ts, over_warn AND NOT ddm_drift AS warn, min(CASE WHEN ddm_drift THEN df.n END) OVER (PARTITION BY df.module) AS fd, min(CASE WHEN ph_drift THEN df.n END) OVER (PARTITION BY df.module) AS fp, adwin_at AS fa
  FROM df JOIN pp ON df.module = pp.module AND df.n = pp.n LEFT JOIN aw ON aw.module = df.module), la AS (
  SELECT *, coalesce((n BETWEEN fd AND fd + 200)::INT, 0) + coalesce((n BETWEEN fp AND fp + 200)::INT, 0) + coalesce((n BETWEEN fa AND fa + 200)::INT, 0) AS k FROM fv), st AS (
  SELECT module, n, ts, coalesce(n = fa, false) AS a, CASE WHEN k >= 2 THEN 'drift' WHEN k = 1 OR warn THEN 'warning' ELSE 'stable' END AS status FROM la)"""


@query("str4_majority_vote", f"WITH {VOTE} SELECT module, status, CASE status WHEN 'drift' THEN 'retrain' WHEN 'warning' THEN 'alert' ELSE 'monitor' END AS action, count(*) AS n, min(n) AS first_row FROM st GROUP BY ALL")
def str4(d: Data):
    return _votes(d).groupBy("module", "status", "action").agg(F.count("*").alias("rows"), F.min("n").alias("first_row")).withColumnRenamed("rows", "n")


define_input("scored_events", "SELECT 'm' || (user_id % 3) AS module, ts, event_id, CAST(event_id * 37 % 101 AS INT) AS score, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'HIGH' WHEN 2 THEN 'CLEAN' WHEN 3 THEN '1' ELSE 'no' END AS truth FROM {events}")


@query("str9_labelled_errors", "SELECT module, event_id, ((score >= 50) <> (truth IN ('HIGH', '1')))::INT AS error FROM {scored_events} WHERE truth IS NOT NULL")
def str9(d: Data):
    s = d.scored_events
    return feed.labelled_errors(s, s.select("event_id", "ts", "truth")).select("module", "event_id", "error")


@query("str10_detection_report", f"""WITH {VOTE}, ch AS (SELECT module, min(n) AS dp FROM nm WHERE ts >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1), lg AS (SELECT module, n, 'adwin' AS detector, a AS fired FROM st UNION ALL SELECT module, n, 'majority', status = 'drift' FROM st)
  SELECT module, detector, min(CASE WHEN fired AND n >= dp THEN n END) AS detected_at, count(*) FILTER (fired AND n < dp) AS false_alarms, min(CASE WHEN fired AND n >= dp THEN n END) - any_value(dp) AS delay FROM lg JOIN ch USING (module) GROUP BY ALL""")
def str10(d: Data):
    change = drift.numbered(d.error_stream).where("ts >= TIMESTAMP_NTZ '2024-01-16 00:00:00'").groupBy("module").agg(F.min("n").alias("drift_point"))
    votes = _votes(d).withColumn("majority", F.col("status") == "drift")
    return drift.detection_report(votes.join(change, "module"), ["adwin", "majority"])


@query("str11_duplicate_payloads", """WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, ts, md5(event_type || (user_id % 20)) AS h FROM {events}), d AS MATERIALIZED (SELECT DISTINCT h, ts FROM e), nx AS MATERIALIZED (
  SELECT a.h, a.ts, min(b.ts) AS nts FROM d a JOIN d b ON a.h = b.h AND b.ts > a.ts + INTERVAL 7200 SECOND GROUP BY ALL), ok(h, ts) AS (
  SELECT h, min(ts) FROM d GROUP BY h UNION ALL SELECT nx.h, nx.nts FROM ok JOIN nx ON nx.h = ok.h AND nx.ts = ok.ts)
  SELECT min(event_id) AS event_id, h AS payload_hash FROM e JOIN ok USING (h, ts) GROUP BY h, ts""")
def str11(d: Data):
    rows = d.events.select("event_id", "ts", F.expr("md5(event_type || (user_id % 20))").alias("payload_hash"))
    return feed.drop_repeats(rows, ttl_seconds=7200, order=("event_id",)).select("event_id", "payload_hash")


@query("str13_spacing", """SELECT event_id, (epoch_us(ts) - epoch_us(p)) / 1000.0::DOUBLE AS gap_ms FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id % 50 ORDER BY ts) AS p FROM {events}) WHERE (epoch_us(ts) - epoch_us(p)) / 1000.0::DOUBLE < 600000""")
def str13(d: Data):
    rows = d.events.select("event_id", "ts", (F.col("user_id") % 50).alias("client"))
    return feed.spacing_violations(rows, min_ms=600_000).select("event_id", "gap_ms")


@query("str8_state_snapshot", """WITH nm AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY module) AS n FROM {error_stream})
  SELECT module, any_value(n) AS n, count(*) FILTER (r > n - 500) AS window_n, CAST(sum(error) FILTER (r > n - 500) AS BIGINT) AS window_errors,
  count(*) FILTER (r <= 500) AS baseline_n, CAST(sum(error) FILTER (r <= 500) AS BIGINT) AS baseline_errors FROM nm GROUP BY module""")
def str8(d: Data):
    """Detectors are stored half way, put into a new stream from that table, and go on to the end."""
    errors = d.error_stream.select("module", F.col("ts").cast("timestamp").alias("ts"), "event_id", "error", F.lit(False).alias("reset"), F.lit(None).cast("string").alias("restore"))
    cut = F.expr("TIMESTAMP '2024-01-16 00:00:00'")
    order = ("ts", "event_id")
    _, checkpoint = drift.run_signals(bounded_stream(errors.where(F.col("ts") < cut)), order)
    half = cut_lineage(drift.state_snapshot(d.spark, checkpoint))
    control = drift.restore_rows(half, cut - F.expr("INTERVAL 1 SECOND"))
    rest = errors.where(F.col("ts") >= cut).unionByName(control, allowMissingColumns=True)
    _, checkpoint = drift.run_signals(bounded_stream(rest), order)
    return drift.state_snapshot(d.spark, checkpoint).select("module", "n", "window_n", "window_errors", "baseline_n", "baseline_errors")


@query("str12_alert_fanout", """WITH a AS (SELECT event_id, lower(risk_level) AS severity FROM {fraud_events}) SELECT 'all' AS sink, severity, count(*) AS n FROM a GROUP BY ALL
  UNION ALL SELECT 'urgent', severity, count(*) FROM a WHERE severity IN ('critical', 'high') GROUP BY ALL""")
def str12(d: Data):
    alerts = bounded_stream(d.fraud_events.select("event_id", F.lower("risk_level").alias("severity")))
    folder = shared_folder(d.spark, "alerts")
    feed.alert_fanout(alerts, f"{folder}/all", f"{folder}/urgent", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kind = "event_id string, severity string"
    sinks = [d.spark.read.schema(kind).parquet(f"{folder}/{name}").select(F.lit(name).alias("sink"), "severity") for name in ("all", "urgent")]
    return sinks[0].unionByName(sinks[1]).groupBy("sink", "severity").agg(F.count("*").alias("n"))
