"""Training-set and model queries."""

from pyspark.sql import functions as F

from ..operators import documents as docs
from ..operators import training as tr
from ..operators import urls
from ..session import cut_lineage, spread
from .documents import RULED
from . import inputs  # noqa: F401
from .registry import Data, query

FEATS = ["brand_palette_distance", "text_height_variance", "ela_hotspot_density", "utr_valid", "ocr_confidence", "font_consistent"]
_BITS = "('0x' || substr(md5('{0}|' || id), 1, 8))::BIGINT"


def _rank(salt: str) -> str:
    return f"""rk AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_BITS.format(salt)}, id) AS r, count(*) OVER (PARTITION BY label) AS total FROM {{receipt_features}})"""


@query("trn1_stratified_split", f"""WITH {_rank('split42')} SELECT id, label, CASE WHEN r <= round(0.7::DOUBLE * total) THEN 'train' WHEN r <= round((0.7::DOUBLE + 0.15::DOUBLE) * total) THEN 'val' ELSE 'test' END AS split FROM rk""")
def trn1(d: Data):
    out = tr.stratified_split(d.receipt_features.select("id", "label"), "id", "label", {"train": 0.7, "val": 0.15, "test": 0.15})
    return out.select("id", "label", "split")


@query("trn2_stratified_folds", f"WITH {_rank('fold42')} SELECT id, label, ((r - 1) % 5)::INT AS fold FROM rk")
def trn2(d: Data):
    return tr.stratified_folds(d.receipt_features.select("id", "label"), "id", "label")


@query("trn3_smote")
def trn3(d: Data):
    out = tr.smote(_rows(d).where(F.col("split") == "train"), "id", "label", FEATS)
    return out.groupBy("label", "synthetic").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in FEATS])


@query("trn4_scaling", "WITH s AS (SELECT " + ", ".join(
    f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in FEATS) + " FROM {receipt_features} WHERE split = 'train') SELECT id, " + ", ".join(
    f"round(({c} - mu_{c}) / CASE WHEN sd_{c} = 0 THEN 1 ELSE sd_{c} END, 8) AS {c}" for c in FEATS) + " FROM {receipt_features}, s")
def trn4(d: Data):
    out = tr.scale(d.receipt_features, FEATS, F.col("split") == "train")
    return out.select("id", *[F.round(c, 8).alias(c) for c in FEATS])


@query("trn5_undersample", f"SELECT id, label FROM {{receipt_features}} WHERE label <> 1 OR {_BITS.format('under42')} / 4294967296.0::DOUBLE < 0.1")
def trn5(d: Data):
    return tr.undersample(d.receipt_features, "id", "label", 1, 0.1).select("id", "label")


@query("trn6_class_weights", "SELECT label, count(*) AS n, round((SELECT count(*) FROM {receipt_features}) / (2.0::DOUBLE * count(*)), 9) AS weight FROM {receipt_features} GROUP BY 1")
def trn6(d: Data):
    w = tr.class_weights(d.receipt_features, "label")
    return w.groupBy("label").agg(F.count("*").alias("n"), F.round(F.max("weight"), 9).alias("weight"))


def _rows(d: Data):
    # Fits read their rows many times, so a row group is dealt over tasks.
    return cut_lineage(spread(d.receipt_features.select("id", "label", "split", *FEATS), task_mb=2))


def _parts(d: Data):
    rows = _rows(d)
    return tuple(rows.where(F.col("split") == s) for s in ("train", "val", "test"))


@query("trn7_model_candidates")
def trn7(d: Data):
    train, _, test = _parts(d)
    return tr.compare_models(train, test, tr.candidates(FEATS))


@query("trn8_calibration")
def trn8(d: Data):
    train, val, test = _parts(d)
    model = tr.candidates(FEATS)["LR"].fit(train)
    held, target = tr.scores(model, val, ["label"]), tr.scores(model, test, ["id", "label"])
    iso = tr.calibrate_isotonic(held, target).select("id", "label", "p", F.col("calibrated").alias("isotonic"))
    platt = tr.calibrate_platt(held, target).select("id", F.col("calibrated").alias("platt"))
    return iso.join(platt, "id")


@query("trn8_isotonic_values", """WITH g AS (SELECT score_a / 100.0::DOUBLE AS p, count(*) AS n, sum(truth)::BIGINT AS s FROM {predictions} WHERE score_a % 2 = 1 GROUP BY 1),
  c AS (SELECT p, row_number() OVER (ORDER BY p) AS i, sum(n) OVER (ORDER BY p) AS cn, sum(s) OVER (ORDER BY p) AS cs FROM g),
  m AS (SELECT a.i AS a, b.i AS b, (b.cs - coalesce(pa.cs, 0)) / (b.cn - coalesce(pa.cn, 0)) AS mean FROM c a JOIN c b ON a.i <= b.i LEFT JOIN c pa ON pa.i = a.i - 1),
  lo AS (SELECT c.i, m.a, min(mean) AS least_mean FROM c JOIN m ON m.a <= c.i AND m.b >= c.i GROUP BY ALL), v AS (SELECT c.p, max(least_mean) AS v FROM c JOIN lo USING (i) GROUP BY 1),
  t AS (SELECT score_b / 100.0::DOUBLE AS x, count(*) AS n FROM {predictions} GROUP BY 1)
  SELECT x AS p, n, round(CASE WHEN b.p IS NULL THEN a.v WHEN b.p = x OR a.p IS NULL THEN b.v ELSE b.v + (a.v - b.v) * (x - b.p) / (a.p - b.p) END, 9) AS calibrated
  FROM t ASOF LEFT JOIN v b ON t.x >= b.p ASOF LEFT JOIN v a ON t.x < a.p""")
def trn8_values(d: Data):
    """Fitted on the odd scores of one model, applied to all scores of the other; the twin has the max-min form of the fit."""
    rows = d.predictions
    held = rows.where("score_a % 2 = 1").select((F.col("score_a") / 100.0).alias("p"), F.col("truth").alias("label"))
    out = tr.calibrate_isotonic(held, rows.select((F.col("score_b") / 100.0).alias("p")))
    return out.groupBy("p").agg(F.count("*").alias("n"), F.round(F.max("calibrated"), 9).alias("calibrated"))


@query("trn9_soft_vote", """SELECT record_id, round((score_a / 100.0::DOUBLE + score_b / 100.0::DOUBLE) / 2, 9) AS p, (round((score_a / 100.0::DOUBLE + score_b / 100.0::DOUBLE) / 2, 9) >= 0.5)::INT AS vote FROM {predictions}""")
def trn9(d: Data):
    rows = d.predictions.select("record_id", (F.col("score_a") / 100.0).alias("pa"), (F.col("score_b") / 100.0).alias("pb"))
    out = tr.soft_vote(rows, ["pa", "pb"])
    return out.select("record_id", F.round("p", 9).alias("p"), (F.round("p", 9) >= 0.5).cast("int").alias("vote"))


@query("trn10_meta_learner")
def trn10(d: Data):
    rows = d.predictions.select(F.col("truth").alias("label"), (F.col("score_a") / 100.0).alias("phish"), (F.col("score_b") / 100.0).alias("doc"),
                                (F.col("latency_ms") / 100.0).alias("upi"))
    return tr.meta_learner(rows, ["phish", "doc", "upi"])


@query("trn11_feature_importance")
def trn11(d: Data):
    train, _, _ = _parts(d)
    model = tr.candidates(FEATS)["RF"].fit(train)
    return tr.feature_importance(model.stages[-1], FEATS, d.spark)


@query("trn12_instruction_rows", f"""WITH {RULED}, told AS (SELECT *, array_to_string(list_transform(rules, lambda r: r || ': ' || CASE r WHEN 'suspicious_editor' THEN 'Made or changed with an image editor.'
    WHEN 'metadata_mismatch' THEN 'Created and modified at different times.' WHEN 'blank_author' THEN 'The author is empty.' WHEN 'encrypted_pdf' THEN 'Encrypted file.'
    ELSE 'Scam wording: ' || array_to_string(phrases, ', ') || '.' END), ', ') AS lines FROM sc)
  SELECT doc_id, '{tr.INSTRUCTION}' AS instruction, 'DOCUMENT FORENSIC SCAN REPORT:' || chr(10) || '- Subject: ' || filename || chr(10) || '- Risk Score: ' || risk_score || chr(10) || '- Indicators: ' || lines AS input,
  'VERDICT: ' || CASE WHEN risk_score > 60 THEN 'FRAUDULENT' WHEN risk_score > 30 THEN 'SUSPICIOUS' ELSE 'GENUINE' END || chr(10) || 'CONFIDENCE: ' || greatest(risk_score, 100 - risk_score) || '%' || chr(10) || 'INDICATORS: ' || len(rules) AS output FROM told""")
def trn12(d: Data):
    # Fixed value: the title of the report.
    out = tr.instruction_rows(docs.analyze(d.docs), "DOCUMENT FORENSIC SCAN REPORT", "filename")
    return out.select("doc_id", "instruction", "input", "output")


_REPORT = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'verdict: FRAUD' || chr(10) || 'CONFIDENCE: ' || (doc_id % 100) || '%' || chr(10) || 'ATTACK_TYPE: ' || source || chr(10) || 'ANALYST_NOTE: see: file'
  WHEN 1 THEN '  VERDICT : GENUINE' || chr(10) || 'CONFIDENCE: high' WHEN 2 THEN 'no structure' ELSE 'VERDICT: A' || chr(10) || 'VERDICT: B' END AS report FROM {documents}"""


@query("trn13_parse_report", f"""WITH r AS ({_REPORT}), p AS (SELECT doc_id, """ + ", ".join(
    f"trim(regexp_extract_all(report, '(?im)^[ \\t]*{k}[ \\t]*:(.*)$', 1)[-1]) AS {n}" for k, n in
    [("VERDICT", "v"), ("CONFIDENCE", "c"), ("ATTACK_TYPE", "a"), ("ANALYST_NOTE", "o")]) + """ FROM r)
  SELECT doc_id, coalesce(v, 'SUSPICIOUS') AS verdict, coalesce(TRY_CAST(trim(replace(c, '%', '')) AS INT), 50) AS confidence, coalesce(a, 'Unknown Attack') AS attack_type, coalesce(o, 'Analysis incomplete.') AS analyst_note FROM p""")
def trn13(d: Data):
    return tr.parse_report(d.sql(_REPORT), "report").drop("report")


@query("eva21_module_ablation")
def eva21(d: Data):
    rows = cut_lineage(d.predictions.select(
        F.col("truth").alias("label"), "record_id", (F.col("score_a") / 100.0).alias("phish"), (F.col("score_b") / 100.0).alias("doc"),
        (F.col("latency_ms") / 100.0).alias("upi")))
    parts = cut_lineage(tr.stratified_split(rows, "record_id", "label", {"train": 0.8, "test": 0.2}))
    cols = ["phish", "doc", "upi"]
    subsets = {"full": cols, **{f"no_{c}": [x for x in cols if x != c] for c in cols}, **{f"{c}_only": [c] for c in cols}}
    return tr.column_ablation(parts.where("split = 'train'"), parts.where("split = 'test'"), subsets, "full")


@query("eva22_feature_group_ablation")
def eva22(d: Data):
    train, _, test = _parts(d)
    image, text = FEATS[:3] + ["font_consistent"], ["utr_valid", "ocr_confidence"]
    return tr.column_ablation(train, test, {"all": FEATS, "image": image, "text": text}, "all")


@query("eva22_url_group_ablation")
def eva22_urls(d: Data):
    """Lexical columns, character n-grams and both, on distinct URLs; the rules' verdicts are the labels."""
    told = urls.score(urls.analyze(d.urls.select("url").distinct())).select("url", (F.col("risk_score") > 30).cast("int").alias("label"))
    rows = cut_lineage(tr.stratified_split(urls.lexical(told), "url", "label", {"train": 0.8, "test": 0.2}))
    lexical = [c for c in rows.columns if c not in ("url", "label", "split")]
    rows = rows.select("url", "label", "split", *[F.col(c).cast("double").alias(c) for c in lexical])
    train, test = tr.with_ngram_weights(rows.where("split = 'train'"), rows.where("split = 'test'"), "url")
    return tr.column_ablation(cut_lineage(train), cut_lineage(test), {
        "all": [*lexical, "ngrams"], "lexical": lexical, "ngram": ["ngrams"]}, "all")


@query("eva23_class_balance_ablation")
def eva23(d: Data):
    train, _, test = _parts(d)
    few = cut_lineage(tr.undersample(train, "id", "label", 1, 0.1))
    lr = lambda rows, w=None: tr.metrics_at(tr.scores(tr.candidates(FEATS, weight=w)["LR"].fit(rows), test, ["label"]))
    arms = {
        "raw": lr(few), "smote": lr(tr.smote(few, "id", "label", FEATS).select("label", *FEATS)),
        "class_weights": lr(tr.class_weights(few, "label"), "weight"),
    }
    out = None
    for name, row in arms.items():
        row = row.select(F.lit(name).alias("strategy"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("eva24_cross_dataset_grid")
def eva24(d: Data):
    train, _, test = _parts(d)
    rows = d.receipt_features
    a = rows.where(F.col("app").isin("phonepay", "googlepay"))
    b = rows.where(F.col("app").isin("paytm", "bhim"))
    pick = lambda x, s: x.where(F.col("split") == s).select("label", *FEATS)
    return tr.cross_grid({"wallets": (pick(a, "train"), pick(a, "test")), "banks": (pick(b, "train"), pick(b, "test"))}, FEATS)


@query("eva29_hardening")
def eva29(d: Data):
    train, _, test = _parts(d)
    return tr.harden(train, test, FEATS, ["brand_palette_distance", "text_height_variance", "ela_hotspot_density", "ocr_confidence"], "id")
