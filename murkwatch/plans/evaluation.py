"""Evaluation queries."""

from pyspark.sql import functions as F

from ..functions import labels as LB
from ..functions import receipts as R
from ..functions import urls as U
from ..functions.exprs import md5_unit, pin
from ..operators import evaluation as ev
from .fusion import CLIP  # noqa: F401  (its inputs are used here)
from .quality import CONSENSUS
from .receipts import CAND
from . import inputs  # noqa: F401
from .registry import Data, define_input, query

POS = "upper({0}) IN ('1', 'TRUE', 'HIGH', 'SUSPICIOUS', 'FRAUD', 'YES')"
T, P = "truth = 1", "score_a >= 30"


def cells(t: str, p: str) -> str:
    return (f"count(*) FILTER (({t}) AND ({p})) AS tp, count(*) FILTER (NOT ({t}) AND ({p})) AS fp, "
            f"count(*) FILTER (NOT ({t}) AND NOT ({p})) AS tn, count(*) FILTER (({t}) AND NOT ({p})) AS fn")


def _d(a, b):
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0)"


PREC, REC = _d("tp", "tp + fp"), _d("tp", "tp + fn")
F1 = _d(f"2 * {PREC} * {REC}", f"{PREC} + {REC}")
MCC = _d("tp::DOUBLE * tn - fp::DOUBLE * fn", "sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))")
M = {"accuracy": _d("tp + tn", "tp + fp + tn + fn"), "precision": PREC, "recall": REC, "f1": F1,
     "fpr": _d("fp", "fp + tn"), "fnr": _d("fn", "fn + tp"), "mcc": MCC}


def mcols(*names):
    return ", ".join(f"round({M[n]}, 9) AS {n}" for n in names)


def r9(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


ALL = ["accuracy", "precision", "recall", "f1", "fpr", "fnr", "mcc"]


@query("eva1_truthiness", f"SELECT true_label, {POS.format('true_label')} AS positive, count(*) AS n FROM {{predictions}} GROUP BY ALL")
def eva1(d: Data):
    return d.predictions.groupBy("true_label", LB.is_positive(F.col("true_label")).alias("positive")).agg(F.count("*").alias("n"))


@query("eva2_classification_metrics", f"SELECT *, {mcols(*ALL)} FROM (SELECT {cells(POS.format('true_label'), POS.format('label_a'))}, count(*) AS support FROM {{predictions}})")
def eva2(d: Data):
    return r9(ev.classification_metrics(d.predictions, "true_label", "label_a"), *ALL)


@query("eva3_mcc_log_loss", f"""WITH c AS (SELECT module, {cells(T, P)} FROM {{predictions}} GROUP BY 1), l AS (SELECT module, avg(-CASE WHEN truth = 1 THEN ln(p) ELSE ln(1 - p) END) AS log_loss FROM (
  SELECT module, truth, greatest(1e-15, least(1 - 1e-15, score_a / 100.0::DOUBLE)) AS p FROM {{predictions}}) GROUP BY 1) SELECT module, round({MCC}, 9) AS mcc, round(log_loss, 9) AS log_loss FROM c JOIN l USING (module)""")
def eva3(d: Data):
    m = ev.classification_metrics(d.predictions, "true_label", "label_a", ["module"]).select("module", "mcc")
    ll = ev.log_loss(d.predictions.withColumn("p", F.col("score_a") / 100.0), "truth", "p", ["module"])
    return r9(m.join(ll, "module"), "mcc", "log_loss")


AUC = """h{0} AS (SELECT {1} score_a AS s, count(*) FILTER (truth = 1) AS pos, count(*) FILTER (truth = 0) AS neg FROM {{predictions}} GROUP BY ALL), b{0} AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY {2} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h{0})"""


@query("eva4_auc", "WITH " + AUC.format("", "module,", "module") + " SELECT module, round(sum(pos * (below + 0.5 * neg))::DOUBLE / (sum(pos) * sum(neg)), 9) AS auc FROM b GROUP BY 1")
def eva4(d: Data):
    return r9(ev.auc(d.predictions, "truth", "score_a", ["module"]), "auc")


_SL = " UNION ALL ".join(
    f"SELECT '{dim}' AS dimension, {col} AS slice, truth, score_a FROM {{predictions}}" for dim, col in
    [("overall", "'all'"), ("difficulty", "difficulty"), ("app", "app")])


@query("eva5_sliced_metrics", f"""WITH r AS ({_SL}), c AS (SELECT dimension, slice, {cells(T, P)}, count(*) AS support FROM r GROUP BY ALL),
  h AS (SELECT dimension, slice, score_a AS s, count(*) FILTER (truth = 1) AS pos, count(*) FILTER (truth = 0) AS neg FROM r GROUP BY ALL), b AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY dimension, slice ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h), a AS (
  SELECT dimension, slice, sum(pos * (below + 0.5 * neg))::DOUBLE / (sum(pos) * sum(neg)) AS auc FROM b GROUP BY ALL)
  SELECT dimension, slice, support, {mcols('precision', 'recall', 'f1', 'mcc')}, round(auc, 9) AS auc FROM c JOIN a USING (dimension, slice)
  UNION ALL SELECT 'difficulty', 'extreme', 0, 0, 0, 0, 0, 0.5""")
def eva5(d: Data):
    out = ev.sliced_metrics(d.predictions, "truth", F.col("score_a") >= 30, "score_a", {
        "difficulty": ["easy", "medium", "hard", "extreme"], "app": ["phonepay", "googlepay", "paytm", "bhim"]})
    return r9(out, "precision", "recall", "f1", "auc", "mcc")


@query("eva6_latency_summary", """SELECT module, round(avg(latency_ms), 9) AS mean, min(latency_ms) AS min, max(latency_ms) AS max, round(quantile_cont(latency_ms, 0.5), 9) AS median,
  round(quantile_cont(latency_ms, 0.95), 9) AS p95, round(quantile_cont(latency_ms, 0.99), 9) AS p99 FROM {predictions} GROUP BY 1""")
def eva6(d: Data):
    return r9(ev.latency_summary(d.predictions, by=["module"]), "mean", "median", "p95", "p99")


_U = "(('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def weight_sql(salt: str, key: str, n: str) -> str:
    u1, u2 = _U.format(f"'{salt}/r|' || {key}"), _U.format(f"'{salt}/t|' || {key}")
    z = f"sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {u1})) * cos(2.0::DOUBLE * pi() * {u2})"
    return f"CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE {n} * greatest(0.0::DOUBLE, 1.0::DOUBLE - 1.0::DOUBLE / (9.0::DOUBLE * {n}) + {z} / (3.0::DOUBLE * sqrt({n}::DOUBLE))) ** 3 END"


@query("eva7_bootstrap_mean", f"""WITH h AS (SELECT score_a AS v, count(*) AS n FROM {{predictions}} GROUP BY 1), r AS (SELECT v, n, unnest(range(1, 1001)) AS rep FROM h), w AS (
  SELECT *, {weight_sql('mean', "(v || '.0|' || rep)", 'n')} AS w FROM r), s AS (SELECT rep, sum(w * v) / sum(w) AS stat FROM w GROUP BY 1)
  SELECT (SELECT round(avg(score_a), 9) FROM {{predictions}}) AS mean, round(quantile_cont(stat, 0.025), 9) AS ci_lower, round(quantile_cont(stat, 0.975), 9) AS ci_upper FROM s""")
def eva7(d: Data):
    return r9(ev.bootstrap_mean(d.predictions, "score_a"), "mean", "ci_lower", "ci_upper")


_BM = ["accuracy", "precision", "recall", "f1"]


@query("eva8_bootstrap_metrics", f"""WITH c AS (SELECT {cells(T, P)} FROM {{predictions}}), r AS (SELECT *, unnest(range(1, 1001)) AS rep FROM c), w AS (SELECT rep, """ + ", ".join(
    f"""{weight_sql('cells', f"('{x}|' || rep)", x)} AS {x}""" for x in ("tp", "fp", "tn", "fn")) + " FROM r), s AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {M[m]} AS stat FROM w" for m in _BM) + "), p AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {M[m]} AS estimate FROM c" for m in _BM) + """)
  SELECT metric, round(any_value(estimate), 9) AS estimate, round(quantile_cont(stat, 0.025), 9) AS ci_lower, round(quantile_cont(stat, 0.975), 9) AS ci_upper FROM s JOIN p USING (metric) GROUP BY 1""")
def eva8(d: Data):
    return r9(ev.bootstrap_metrics(d.predictions, F.col("truth") == 1, F.col("score_a") >= 30), "estimate", "ci_lower", "ci_upper")


_SB = {"f1": F1, "precision": PREC, "recall": REC, "mcc": MCC}
_LO, _HI = (int(x * 2000) for x in ((1 - 0.95) / 2, 1 - (1 - 0.95) / 2))


@query("eva9_stratified_bootstrap", f"""WITH h AS (SELECT truth AS y, score_a >= 30 AS p, score_a AS s, count(*) AS n FROM {{predictions}} GROUP BY ALL), r AS (SELECT *, unnest(range(1, 2001)) AS rep FROM h), d AS (
  SELECT *, {weight_sql('strata', "(y || '|' || p::VARCHAR || '|' || s || '.0|' || rep)", 'n')} AS g FROM r), w AS (SELECT *, g * sum(n) OVER c / sum(g) OVER c AS v FROM d WINDOW c AS (PARTITION BY rep, y)), b AS (
  SELECT rep, s, coalesce(sum(v) FILTER (y = 1 AND p), 0) AS tp, coalesce(sum(v) FILTER (y = 0 AND p), 0) AS fp, coalesce(sum(v) FILTER (y = 0 AND NOT p), 0) AS tn, coalesce(sum(v) FILTER (y = 1 AND NOT p), 0) AS fn FROM w GROUP BY ALL), o AS (
  SELECT *, coalesce(sum(fp + tn) OVER (PARTITION BY rep ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b), t AS (
  SELECT rep, sum((tp + fn) * (below + 0.5 * (fp + tn))) / (sum(tp + fn) * sum(fp + tn)) AS auc, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM o GROUP BY rep), m AS (
  SELECT 'auc' AS metric, auc AS stat FROM t UNION ALL """ + " UNION ALL ".join(f"SELECT '{m}', {x} FROM t" for m, x in _SB.items()) + f"""), k AS (
  SELECT metric, stat, row_number() OVER (PARTITION BY metric ORDER BY stat) - 1 AS i FROM m), e AS (SELECT {cells(T, P)} FROM {{predictions}}), q AS (
  SELECT score_a AS s, count(*) FILTER (truth = 1) AS pos, count(*) FILTER (truth = 0) AS neg FROM {{predictions}} GROUP BY 1), u AS (
  SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM q), z AS (
  SELECT 'auc' AS metric, sum(pos * (less + 0.5 * neg)) / (sum(pos) * sum(neg)) AS estimate FROM u UNION ALL """ + " UNION ALL ".join(f"SELECT '{m}', {x} FROM e" for m, x in _SB.items()) + f""")
  SELECT metric, round(any_value(estimate), 8) AS estimate, round(max(stat) FILTER (i = {_LO}), 8) AS ci_lower, round(max(stat) FILTER (i = {_HI}), 8) AS ci_upper FROM k JOIN z USING (metric) GROUP BY metric""")
def eva9(d: Data):
    out = ev.stratified_bootstrap(d.predictions, "truth", F.col("score_a") >= 30, "score_a")
    return out.select("metric", *[F.round(c, 8).alias(c) for c in ("estimate", "ci_lower", "ci_upper")])


def place(tag: str, score: str) -> str:
    return f"""h{tag} AS (SELECT {score} AS s, count(*) FILTER (truth = 1) AS pos, count(*) FILTER (truth = 0) AS neg FROM {{predictions}} GROUP BY 1), v{tag} AS (
  SELECT s, pos, neg, sum(pos) OVER () AS m, sum(neg) OVER () AS n, (coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5 * neg)::DOUBLE / sum(neg) OVER () AS v10,
  (coalesce(sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5 * pos)::DOUBLE / sum(pos) OVER () AS v01 FROM h{tag})"""


@query("eva10_delong_ci", f"""WITH {place('a', 'score_a')}, x AS (SELECT p.truth, v.v10, v.v01 FROM {{predictions}} p JOIN va v ON v.s = p.score_a), y AS (
  SELECT avg(v10) FILTER (truth = 1) AS auc, sqrt(var_samp(v10) FILTER (truth = 1) / count(*) FILTER (truth = 1) + var_samp(v01) FILTER (truth = 0) / count(*) FILTER (truth = 0)) AS se FROM x)
  SELECT round(auc, 8) AS auc, round(se, 8) AS se, round(greatest(0, auc - 1.959963984540054 * se), 8) AS ci_lower, round(least(1, auc + 1.959963984540054 * se), 8) AS ci_upper FROM y""")
def eva10(d: Data):
    return ev.delong_ci(d.predictions, "truth", "score_a").select(*[F.round(c, 8).alias(c) for c in ("auc", "se", "ci_lower", "ci_upper")])


@query("eva11_delong_compare", f"""WITH {place('a', 'score_a')}, {place('b', 'score_b')}, x AS (SELECT p.truth, a.v10 AS xa, a.v01 AS ya, b.v10 AS xb, b.v01 AS yb FROM {{predictions}} p JOIN va a ON a.s = p.score_a JOIN vb b ON b.s = p.score_b), y AS (
  SELECT avg(xa) FILTER (truth = 1) AS auc_a, avg(xb) FILTER (truth = 1) AS auc_b, (var_samp(xa) FILTER (truth = 1) + var_samp(xb) FILTER (truth = 1) - 2 * covar_samp(xa, xb) FILTER (truth = 1)) / count(*) FILTER (truth = 1)
    + (var_samp(ya) FILTER (truth = 0) + var_samp(yb) FILTER (truth = 0) - 2 * covar_samp(ya, yb) FILTER (truth = 0)) / count(*) FILTER (truth = 0) AS v FROM x)
  SELECT round(auc_a, 8) AS auc_a, round(auc_b, 8) AS auc_b, round((auc_a - auc_b) / sqrt(v), 5) AS z_statistic FROM y""")
def eva11(d: Data):
    return ev.delong_compare(d.predictions, "truth", "score_a", "score_b").select(
        F.round("auc_a", 8).alias("auc_a"), F.round("auc_b", 8).alias("auc_b"), F.round("z_statistic", 5).alias("z_statistic"))


@query("eva11_delong_p_value")
def eva11_p(d: Data):
    return ev.delong_compare(d.predictions, "truth", "score_a", "score_b")


@query("eva12_mcnemar", """SELECT difficulty, b, c, CASE WHEN b + c = 0 THEN 0 WHEN b + c < 25 THEN least(b, c) ELSE (abs(b - c) - 1.0::DOUBLE) ** 2 / (b + c) END::DOUBLE AS statistic FROM (
  SELECT difficulty, count(*) FILTER ((score_a >= 30) = (truth = 1) AND (score_b >= 30) <> (truth = 1)) AS b, count(*) FILTER ((score_a >= 30) <> (truth = 1) AND (score_b >= 30) = (truth = 1)) AS c FROM {predictions} GROUP BY 1)""")
def eva12(d: Data):
    return _mcnemar(d).select("difficulty", "b", "c", "statistic")


@query("eva12_mcnemar_p_value")
def eva12_p(d: Data):
    return _mcnemar(d)


def _mcnemar(d: Data):
    return ev.mcnemar(d.predictions, F.col("truth") == 1, F.col("score_a") >= 30, F.col("score_b") >= 30, ["difficulty"])


@query("eva13_paired_differences", "SELECT record_id, score_a - score_b AS difference FROM {predictions}")
def eva13(d: Data):
    a = d.predictions.select("record_id", F.col("score_a").alias("v"))
    b = d.predictions.select("record_id", F.col("score_b").alias("v"))
    return ev.paired_differences(a, b, "record_id", "v")


VOTES = f"votes AS (SELECT record_id, provider, {CONSENSUS} AS label FROM {{consensus}})"
RES = VOTES + """, vc AS (SELECT record_id, label, count(*) AS k FROM votes GROUP BY ALL), major AS (SELECT record_id, arg_max(label, (CASE WHEN label = 'UNKNOWN' THEN 0 ELSE k END) * 10 + CASE label WHEN 'HIGH' THEN 3 WHEN 'SUSPICIOUS' THEN 2 WHEN 'CLEAN' THEN 1 ELSE 0 END) AS label FROM vc GROUP BY 1), j AS (
  SELECT p.*, m.label AS cl, coalesce(m.label <> 'UNKNOWN', false) AS known FROM {predictions} p LEFT JOIN major m USING (record_id))"""


def _votes(d: Data):
    return d.consensus.select("record_id", "provider", LB.consensus_label(F.col("raw_label")).alias("label"))


def _majority(d: Data):
    return ev.resolve_majority(_votes(d))


@query("eva14_agreement", f"""WITH {RES} SELECT count(*) AS total_records, count(*) FILTER (known) AS comparable_records, count(*) FILTER (known AND cl = label_a) AS agreement_count, count(*) FILTER (known AND cl <> label_a) AS disagreement_count,
  count(*) FILTER (NOT known) AS unknown_count, round(count(*) FILTER (known AND cl = label_a) / count(*) FILTER (known), 9) AS agreement_rate,
  round(count(*) FILTER (known AND cl <> 'CLEAN' AND cl = label_a) / count(*) FILTER (known AND cl <> 'CLEAN'), 9) AS high_risk_agreement_rate FROM j""")
def eva14(d: Data):
    return r9(ev.agreement(d.predictions, _majority(d)), "agreement_rate", "high_risk_agreement_rate")


@query("eva14_disagreements", f"WITH {RES} SELECT record_id, label_a AS predicted_label, cl AS consensus_label FROM j WHERE known AND cl <> label_a")
def eva14_rows(d: Data):
    return ev.disagreements(d.predictions, _majority(d))


@query("eva15_consensus_confusion", f"WITH {RES} SELECT *, {mcols(*ALL)} FROM (SELECT {cells(POS.format('cl'), POS.format('label_a'))}, count(*) AS support FROM j WHERE known)")
def eva15(d: Data):
    return r9(ev.consensus_confusion(d.predictions, _majority(d)), *ALL)


@query("eva16_consensus_resolution", f"""WITH {RES}, pr AS (SELECT record_id, arg_min(label, CASE WHEN label = 'UNKNOWN' THEN 9 WHEN provider = 'vendor_b' THEN 0 WHEN provider = 'vendor_a' THEN 1 ELSE 2 END) AS priority_label FROM votes GROUP BY 1)
  SELECT label AS majority_label, priority_label, count(*) AS n FROM major JOIN pr USING (record_id) GROUP BY ALL""")
def eva16(d: Data):
    m = _majority(d).withColumnRenamed("label", "majority_label")
    p = ev.resolve_priority(_votes(d), ["vendor_b", "vendor_a"]).withColumnRenamed("label", "priority_label")
    return m.join(p, "record_id").groupBy("majority_label", "priority_label").agg(F.count("*").alias("n"))


@query("eva17_class_agreement", f"""WITH {RES}, s AS (SELECT count(*) FILTER (known)::DOUBLE AS n, count(*) AS total, count(*) FILTER (known AND cl = label_a) AS same, """ + ", ".join(
    f"count(*) FILTER (known AND cl = '{c}') AS t{i}, count(*) FILTER (known AND label_a = '{c}') AS p{i}, count(*) FILTER (known AND cl = '{c}' AND label_a = '{c}') AS s{i}" for i, c in enumerate(LB.LABELS)) + """ FROM j)
  SELECT round(same / n, 9) AS overall_agreement_rate, round(s0 / t0, 9) AS clean_agreement_rate, round(s1 / t1, 9) AS suspicious_agreement_rate, round(s2 / t2, 9) AS high_agreement_rate, round(n / total, 9) AS consensus_coverage,
  round((same / n - (t0 * p0 + t1 * p1 + t2 * p2) / (n * n)) / (1 - (t0 * p0 + t1 * p1 + t2 * p2) / (n * n)), 9) AS cohen_kappa FROM s""")
def eva17(d: Data):
    out = ev.class_agreement(d.predictions, _majority(d))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


TP_, PP_ = POS.format("true_label"), POS.format("label_a")
ERR = f"""err AS (SELECT record_id, true_label, label_a AS predicted_label, score_a AS predicted_score, CASE WHEN {TP_} THEN 'FALSE_NEGATIVE' ELSE 'FALSE_POSITIVE' END AS error_type,
  CASE WHEN error IS NOT NULL THEN 'API_ERROR' WHEN contains(lower(explanation), 'no active signals') THEN 'NO_ACTIVE_SIGNALS' WHEN NOT {TP_} AND score_a > 0 AND score_a < 50 THEN 'OVER_SENSITIVE'
    WHEN {TP_} AND flag_count > 0 THEN 'CORRELATION_MISS' ELSE 'FORENSICS_FAILURE' END AS category FROM {{predictions}} WHERE ({TP_}) <> ({PP_}))"""


def _errors(d: Data):
    return ev.error_cases(d.predictions.drop("true_label"), d.predictions)


@query("eva18_error_taxonomy", f"WITH {ERR} SELECT * FROM err")
def eva18(d: Data):
    return _errors(d)


@query("eva19_error_rollup", f"""WITH {ERR}, c AS (SELECT 'error_type' AS dimension, error_type AS value, count(*) AS n FROM err GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM err GROUP BY 2)
  SELECT dimension, value, n, round(n / sum(n) OVER (PARTITION BY dimension) * 100, 9) AS share_pct FROM c""")
def eva19(d: Data):
    return r9(ev.error_rollup(_errors(d)), "share_pct")


@query("eva19_error_samples", f"WITH {ERR} SELECT * FROM err ORDER BY record_id LIMIT 5")
def eva19_samples(d: Data):
    return ev.error_samples(_errors(d))


define_input("ablation_cases", """
SELECT case_id, document, phishing, upi, CASE WHEN case_id * 17 % 10 < 4 THEN 'HIGH' ELSE 'CLEAN' END AS true_label FROM {case_scores}
""")
_VAR = {"full": (.35, .35, .30), "no_document_signal": (None, .35, .30), "no_phishing_signal": (.35, None, .30),
        "no_upi_signal": (.35, .35, None), "equal_weights": (.3333, .3333, .3334)}
_ARMS = " UNION ALL ".join(
    f"SELECT '{k}' AS variant, true_label, {('CASE WHEN document IS NOT NULL THEN greatest(0, least(100, document)) END' if a is not None else 'NULL')}::DOUBLE AS dd, {('phishing' if b is not None else 'NULL')}::DOUBLE AS pp, {('upi' if c is not None else 'NULL')}::DOUBLE AS uu, {a or 0}::DOUBLE AS wa, {b or 0}::DOUBLE AS wb, {c or 0}::DOUBLE AS wc FROM {{ablation_cases}}"
    for k, (a, b, c) in _VAR.items())
ABL = f"""arms AS ({_ARMS}), ws AS (SELECT *, CASE WHEN dd IS NULL THEN 0 ELSE wa END + CASE WHEN pp IS NULL THEN 0 ELSE wb END + CASE WHEN uu IS NULL THEN 0 ELSE wc END AS tw FROM arms), us AS (
  SELECT *, CASE WHEN tw = 0 THEN 0 ELSE round_even(round(coalesce(dd, 0) * (wa / tw) + coalesce(pp, 0) * (wb / tw) + coalesce(uu, 0) * (wc / tw), 9), 0) END AS u FROM ws), ab AS (
  SELECT variant, {cells("true_label = 'HIGH'", "u >= 30")}, count(*) AS support FROM us GROUP BY 1)"""


@query("eva20_signal_ablation", f"WITH {ABL} SELECT *, {mcols(*ALL)} FROM ab")
def eva20(d: Data):
    return r9(ev.signal_ablation(d.ablation_cases), *ALL)


@query("eva20_best_variant", f"WITH {ABL} SELECT variant, {mcols('f1', 'accuracy')} FROM ab ORDER BY {M['f1']} DESC, {M['accuracy']} DESC, variant LIMIT 1")
def eva20_best(d: Data):
    return r9(ev.best_variant(ev.signal_ablation(d.ablation_cases)).select("variant", "f1", "accuracy"), "f1", "accuracy")


_FOLD = _U.format("'fold|' || record_id")


@query("eva25_fold_comparison", f"""WITH r AS (SELECT truth, floor({_FOLD} * 5)::INT AS fold, m.model, CASE m.model WHEN 'a' THEN score_a ELSE score_b END >= 30 AS p FROM {{predictions}}, (VALUES ('a'), ('b')) m(model)), c AS (
  SELECT model, fold, {cells('truth = 1', 'p')} FROM r GROUP BY ALL), l AS (""" + " UNION ALL ".join(
    f"SELECT model, '{m}' AS metric, {M[m]} AS value FROM c" for m in ("accuracy", "precision", "recall", "f1", "mcc")) + ") SELECT model, metric, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std FROM l GROUP BY ALL")
def eva25(d: Data):
    rows = d.predictions.withColumn("fold", F.floor(md5_unit("fold", "record_id") * 5).cast("int"))
    return r9(ev.fold_comparison(rows, "truth", {"a": F.col("score_a") >= 30, "b": F.col("score_b") >= 30}, "fold"), "mean", "std")


RULE = ev.LinearRule(0.2, {"brand_palette_distance": 1.5, "ela_hotspot_density": 1.0, "utr_valid": -1.0, "ocr_confidence": -0.6})


def margin(p="brand_palette_distance", e="ela_hotspot_density", v="utr_valid", o="ocr_confidence") -> str:
    return f"round(0.2::DOUBLE + 1.5::DOUBLE * ({p}) + 1.0::DOUBLE * ({e}) - 1.0::DOUBLE * ({v}) - 0.6::DOUBLE * ({o}), 9) > 0"


_DROP = _U.format("'ocr|' || id") + " < 0.35"
_NOISE = f"greatest(0, least(2, brand_palette_distance + ({_U.format(chr(39) + 'shift|' + chr(39) + ' || id')} - 0.5) * 0.2))"


@query("eva26_scenario_robustness", f"""WITH s AS (SELECT label, 'clean' AS scenario, {margin()} AS p FROM {{receipt_features}}
  UNION ALL SELECT label, 'ocr_failure', {margin(v=f'CASE WHEN {_DROP} THEN 0 ELSE utr_valid END', o=f'CASE WHEN {_DROP} THEN 0 ELSE ocr_confidence END')} FROM {{receipt_features}}
  UNION ALL SELECT label, 'layout_shift', {margin(p=_NOISE)} FROM {{receipt_features}}
  UNION ALL SELECT label, 'evasion', {margin(p='CASE WHEN label = 1 THEN 0.02 ELSE brand_palette_distance END', e='CASE WHEN label = 1 THEN 0.02 ELSE ela_hotspot_density END')} FROM {{receipt_features}}), c AS (
  SELECT scenario, {cells('label = 1', 'p')}, count(*) AS support FROM s GROUP BY 1) SELECT scenario, support, {mcols('precision', 'recall', 'f1')} FROM c""")
def eva26(d: Data):
    drop = md5_unit("ocr", "id") < 0.35
    fraud = F.col("label") == 1
    shift = F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.col("brand_palette_distance") + (md5_unit("shift", "id") - 0.5) * 0.2))
    scenarios = {
        "clean": {}, "layout_shift": {"brand_palette_distance": shift},
        "ocr_failure": {c: F.when(drop, 0.0).otherwise(F.col(c)) for c in ("utr_valid", "ocr_confidence")},
        "evasion": {c: F.when(fraud, 0.02).otherwise(F.col(c)) for c in ("brand_palette_distance", "ela_hotspot_density")},
    }
    out = ev.scenario_robustness(d.receipt_features, "id", "label", scenarios, RULE)
    return r9(out.select("scenario", "support", "precision", "recall", "f1"), "precision", "recall", "f1")


_EPS = [0.01, 0.05, 0.10, 0.20]
_COLS = {"brand_palette_distance": -1, "ela_hotspot_density": -1, "ocr_confidence": 1}


def _moved(c, sign):
    x = f"{c} + CASE WHEN label = 1 THEN {sign} ELSE {-sign} END * eps * CASE WHEN sd_{c} > 0 THEN sd_{c} ELSE 1 END"
    x = f"CASE WHEN lo_{c} >= 0 THEN greatest({x}, 0) ELSE {x} END"
    return f"CASE WHEN hi_{c} <= 1 THEN least({x}, 1) ELSE {x} END AS n_{c}"


ATT = f"""st AS (SELECT {", ".join(f"stddev_pop({c}) AS sd_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in _COLS)} FROM {{receipt_features}}), pt AS (
  SELECT f.*, e.eps, {margin()} AS before, {", ".join(_moved(c, s) for c, s in _COLS.items())} FROM {{receipt_features}} f, st, (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.10::DOUBLE), (0.20::DOUBLE)) e(eps)), att AS (
  SELECT *, {margin('n_brand_palette_distance', 'n_ela_hotspot_density', 'utr_valid', 'n_ocr_confidence')} AS after FROM pt), ar AS (
  SELECT eps, count(*) FILTER (label = 1 AND before) AS caught, count(*) FILTER (label = 1 AND before AND NOT after) AS flipped FROM att GROUP BY 1)"""


def _attacked(d: Data):
    return ev.sign_step(d.receipt_features, "label", RULE, _EPS, [*_COLS, "utr_valid"])


@query("eva27_attack_success", f"WITH {ATT} SELECT eps, caught, flipped, round({_d('flipped', 'caught')}, 9) AS asr FROM ar")
def eva27(d: Data):
    return r9(ev.attack_success(_attacked(d), "label", F.col("pred_before"), RULE.decide()), "asr")


@query("eva27_robustness", f"WITH {ATT}, a AS (SELECT 1 - avg({_d('flipped', 'caught')}) AS r FROM ar) SELECT round(r, 9) AS robustness, CASE WHEN r >= 0.8 THEN 'ROBUST' WHEN r >= 0.55 THEN 'MODERATE' ELSE 'VULNERABLE' END AS verdict FROM a")
def eva27_verdict(d: Data):
    return r9(ev.robustness(ev.attack_success(_attacked(d), "label", F.col("pred_before"), RULE.decide())), "robustness")


@query("eva28_sign_step", f"WITH {ATT} SELECT eps, label, count(*) AS n, " + ", ".join(
    f"round(avg(n_{c}), 8) AS {c}" for c in _COLS) + ", round(avg(utr_valid), 8) AS utr_valid FROM att GROUP BY ALL")
def eva28(d: Data):
    return _attacked(d).groupBy("eps", "label").agg(
        F.count("*").alias("n"), *[F.round(F.avg(c), 8).alias(c) for c in [*_COLS, "utr_valid"]])


@query("eva30_experiment_rollup", f"""WITH {RES}, m AS (SELECT module, {cells(TP_, PP_)}, count(*) AS support, avg(latency_ms) AS mean, quantile_cont(latency_ms, 0.5) AS median, quantile_cont(latency_ms, 0.95) AS p95, quantile_cont(latency_ms, 0.99) AS p99, count(*) FILTER (({TP_}) <> ({PP_})) AS errors,
  count(*) FILTER (known AND cl = label_a) / count(*) FILTER (known) AS ag FROM j GROUP BY 1) SELECT module, support, {mcols('accuracy', 'precision', 'recall', 'f1')}, round(mean, 9) AS mean, round(median, 9) AS median, round(p95, 9) AS p95, round(p99, 9) AS p99, round(ag, 9) AS agreement_rate, errors FROM m""")
def eva30(d: Data):
    out = ev.experiment_rollup(d.predictions, _majority(d))
    rounded = ["accuracy", "precision", "recall", "f1", "mean", "median", "p95", "p99", "agreement_rate"]
    return r9(out.select("module", "support", *rounded, "errors"), *rounded)


@query("eva31_baseline_run", f"""WITH {CAND}, u AS (SELECT receipt_id, tamper_suspected AS y, lower(ocr_text) AS low, nutr, ocr_text FROM utr1), s AS (
  SELECT y, 'utr_format' AS model, NOT (regexp_matches(nutr, '^\\d{{12}}$') AND substr(nutr, 1, 1) IN ('3', '4', '5', '6')) AS p FROM u
  UNION ALL SELECT y, 'url_keyword', len(list_filter(['login', 'secure', 'verify', 'update', 'chase', 'paypal', 'upi', 'paytm', 'gpay', 'phonepe', 'free', 'gift', 'prize'], lambda w: contains(low, w))) >= 1 FROM u
  UNION ALL SELECT y, 'url_length', length(split_part(ocr_text, '/', 1)) > 20 FROM u), c AS (SELECT model, {cells('y', 'p')}, count(*) AS support FROM s GROUP BY 1) SELECT *, {mcols(*ALL)} FROM c""")
def eva31(d: Data):
    rows = pin(d.receipts, {"c": R.utr_candidates(F.col("ocr_text"))}).withColumn("utr", F.get("c", 0))
    t = F.col("ocr_text")
    out = ev.baseline_run(rows, F.col("tamper_suspected"), {
        "utr_format": R.utr_baseline(F.col("utr")), "url_keyword": U.keyword_baseline(t), "url_length": U.length_baseline(t)})
    return r9(out, *ALL)
