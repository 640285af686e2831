"""Folds, the marked best model, and hashed n-gram columns."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from murkwatch.operators import training as tr


def _model(columns):
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), LogisticRegression(labelCol="label")])


def test_folds_score_each_real_row_once(spark):
    df = spark.range(600).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("label"), ((F.col("id") * 37) % 101).cast("double").alias("noise"),
                                 ((F.col("id") % 4 == 0).cast("double") * 2 + (F.col("id") * 17 % 50) / 25.0).alias("signal"))
    models = {"good": _model(["signal"]), "poor": _model(["noise"])}
    each = tr.fold_metrics(df, "id", ["noise", "signal"], models, k=3, parallel=2)
    rows = each.collect()
    assert len(rows) == 6 and sorted(r.fold for r in rows if r.model == "good") == [0, 1, 2]
    assert sum(r.support for r in rows if r.model == "poor") == 600  # synthetic rows are never scored
    out = {r.model: r for r in tr.fold_summary(each).collect()}
    assert out["good"].best and not out["poor"].best and out["good"].auc > 0.95 and out["good"].folds == 3
    assert out["good"].f1 == pytest.approx(sum(r.f1 for r in rows if r.model == "good") / 3)


@pytest.mark.parametrize("kept", [True, False])
def test_forest_keeps_node_ids_where_they_are_small(spark, kept, monkeypatch):
    df = spark.range(400).select((F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") * 37 % 101).cast("double").alias("a"), (F.col("id") * 17 % 50).cast("double").alias("b"))
    plain = tr.candidates(["a", "b"], trees=4)["RF"]
    plain.setStages([*plain.getStages()[:-1], RandomForestClassifier(labelCol="label", numTrees=4, maxDepth=15, seed=42)])
    if not kept:
        monkeypatch.setattr(tr, "NODE_IDS_MB", 0)
    model = tr.candidates(["a", "b"], trees=4)["RF"].copy().fit(df)
    assert model.stages[-1].getOrDefault("cacheNodeIds") is kept
    assert model.stages[-1].toDebugString.split("\n", 1)[1] == plain.fit(df).stages[-1].toDebugString.split("\n", 1)[1]


def test_char_ngrams(spark):
    df = spark.createDataFrame([("Ab",), ("",), (None,)], "t string").select(tr.char_ngrams(F.col("t")).alias("g"))
    got = [r.g for r in df.collect()]
    assert got == [[" a", "ab", "b ", " ab", "ab ", " ab "], ["  "], ["  "]]


def test_ngram_weights_come_from_training_rows(spark):
    train = spark.createDataFrame([("aa",), ("ab",)], "t string")
    test = spark.createDataFrame([("zz",), ("aa",)], "t string")
    left, right = tr.with_ngram_weights(train, test, "t", slots=1 << 12)
    seen = left.where("t = 'aa'").first().ngrams
    rows = {r.t: r.ngrams for r in right.collect()}
    assert rows["aa"] == seen and seen.numNonzeros() > 0 and left.columns == ["t", "ngrams"]
