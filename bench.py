"""Headline queries, one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and threads.
Each query is executed in full with a sink that writes nothing.
"""

import json
import os
import sys
import time

from murkwatch.plans import catalog
from murkwatch.session import build_session

HEADLINE = [
    "url1_lexical_features", "url13_rule_hits", "url14_risk_score", "url15_registration_join", "rcp4_utr_candidates",
    "rcp10_forgery_score", "doc1_top_keywords", "doc10_risk_score", "dna1_tfidf", "dna3_similar_pairs", "dna4_clusters", "dna7_campaigns",
    "fus3_unified_score", "agg1_store_statistics", "agg5_timeline", "agg8_dataset_profile", "dq6_duplicates", "dq8_leak_scan",
    "red7_anonymize_records", "eva2_classification_metrics", "eva4_auc", "eva6_latency_summary", "eva9_stratified_bootstrap", "eva11_delong_compare",
    "eva14_agreement", "eva20_signal_ablation", "trn1_stratified_split", "trn3_smote", "str3_error_rates", "str5_ddm",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "20g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["agg3_risk_distribution"](spark, folder).collect()  # session warm-up
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds over headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
