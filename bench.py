"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with seconds per query."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewright.plans import load
from tablewright.session import build_session

HEADLINE = [
    "scan_csv", "dataset_profile", "strong_correlations", "null_share", "class_distribution", "quantiles_exact",
    "string_length_stats", "grade_join", "encode_unseen", "medal_rollup", "rank_ensemble", "metric_issues", "early_stop",
    "sample_fraction", "split_stratified", "kfold_stratified", "impute_median", "scale_robust", "poly2", "text_clean",
    "tfidf_word", "tfidf_char", "log_metrics", "error_action", "array_resample", "validate_submission", "metric_auc",
    "grade_submission", "stream_metric_issues", "stream_medal_report",
]
ROWS_PER_SECOND = {"dataset_profile": "lineitem", "tfidf_word": "documents", "metric_auc": "labels", "validate_submission": "documents"}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    queries["project_numeric"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM start is not measured
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    rates = {q: round(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() / seconds[q]) for q, t in ROWS_PER_SECOND.items()}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "rows_per_sec": rates,
    }))


if __name__ == "__main__":
    main()
