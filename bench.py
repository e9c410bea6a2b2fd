"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose tables and cores. Each
query runs on whole tables and its result is consumed in full. A first round warms the JVM
up; the second is reported. BENCH_COLD=1 reports the first round instead.
"""

from __future__ import annotations

import json
import os
import time

from tabspark.catalog import QUERIES
from tabspark.session import local_session

HEADLINE = [
    "dataset_summary", "quality_report", "quality_report_lineitem", "describe_numeric", "corr_matrix", "histogram_by",
    "box_stats_by", "value_counts", "quantiles_bracketed", "csv_roundtrip", "clip_outliers", "fill_mode", "derive_formula",
    "recipe_replay", "ordinal_encode_large", "prep_matrix", "holdout_split", "stratified_kfold", "accuracy_macro",
    "regression_metrics", "ridge_fit", "ridge_score", "linear_contributions", "waterfall", "run_metrics", "tune_ridge",
    "cv_scores", "rf_classify", "gbt_regress", "logistic", "score_proba", "tree_contributions", "mlp_regress", "learning_curve",
    "gbt_multiclass",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("OFF")
    only = os.environ.get("BENCH_QUERIES")
    names = [n for n in (only.split(",") if only else HEADLINE)]
    rounds = 1 if os.environ.get("BENCH_COLD") else 2
    seconds: dict[str, float] = {}
    for _ in range(rounds):
        for name in names:
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
