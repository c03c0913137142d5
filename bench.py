"""Times the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the list below).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewright.catalog import all_queries
from tablewright.session import local_session

HEADLINE = [
    "numeric_stats",
    "categorical_stats",
    "correlation_matrix",
    "histogram",
    "boxplot",
    "duplicate_rows",
    "top_values",
    "target_candidates",
    "profile",
    "stratified_split",
    "impute_median",
    "standard_scale",
    "feature_matrix",
    "frequency_encode",
    "engineer_features",
    "classification_metrics",
    "roc_auc_fine_scores",
    "roc_auc_ovr",
    "linear_shap",
    "leaderboard",
    "prediction_stats",
    "csv_round_trip",
    "batch_score_regression",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # start the JVM's code paths and the Python workers before the clock runs
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
