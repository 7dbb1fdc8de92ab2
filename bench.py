"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scoreloom.catalog import QUERIES  # noqa: E402
from scoreloom.session import get_session  # noqa: E402

HEADLINE = [
    "missing_table",
    "iv_summary",
    "woe_apply",
    "kfold_target_encode",
    "mean_encode_oof",
    "label_encode",
    "stratified_kfold",
    "auc_gini",
    "roc_mean_curve",
    "corr_matrix",
    "closest_fit",
    "hot_deck_fill",
    "bpca_fit",
    "bpca_impute",
    "smote",
    "clean_recipe",
    "scaled_fit_score",
]


def run_once(spark, sf_dir: str, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = get_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        if runs > 1:
            run_once(spark, sf_dir, name)
        seconds[name] = round(statistics.median(run_once(spark, sf_dir, name) for _ in range(runs)), 3)
    spark.stop()
    result = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
