"""The catalogue is complete and every registered query plans on the smallest tables."""

import pytest

import __spark_entry__ as entry
from murkwatch.plans import catalog

SF = "/root/testdata/sf0.001"
# No SQL twin: IDN encoding, model fits, p values.
ROWS_ONLY = {
    "url6_punycode_hosts", "eva11_delong_p_value", "eva12_mcnemar_p_value",
    "trn3_smote", "trn7_model_candidates", "trn8_calibration", "trn10_meta_learner", "trn11_feature_importance",
    "eva21_module_ablation", "eva22_feature_group_ablation", "eva22_url_group_ablation", "eva23_class_balance_ablation", "eva24_cross_dataset_grid", "eva29_hardening",
}


def test_twins():
    names, twins = set(catalog.QUERIES), set(catalog.ORACLES)
    assert twins <= names and names - twins == ROWS_ONLY
    assert names <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert {r.risk_level for r in entry.entry(spark).collect()} <= {"CLEAN", "SUSPICIOUS", "HIGH"}


@pytest.mark.parametrize("name", ["agg5_timeline", "fus3_unified_score", "dq7_missing_files", "trn2_stratified_folds"])
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_filters_reach_the_scan(spark):
    plan = entry.queries()["agg5_timeline"](spark, SF)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "props" not in plan.split("== Physical Plan ==")[1]


def test_model_candidates_are_those_of_the_operator(spark, monkeypatch):
    from murkwatch.operators import training as tr

    seen = {}
    monkeypatch.setattr(tr, "compare_models", lambda train, test, models: seen.update(models))
    entry.queries()["trn7_model_candidates"](spark, SF)
    assert seen["RF"].getStages()[-1].getNumTrees() == 200 and seen["GBT"].getStages()[-1].getMaxIter() == 200
