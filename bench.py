"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query is
computed in full into a sink that keeps nothing; the first one is run once before
the clock starts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from relloom.runtime import local_session
from relloom.workload import QUERIES

HEADLINE = [
    "customer_feature_matrix",
    "order_feature_matrix",
    "supplier_feature_matrix",
    "interval_feature_export",
    "feature_catalog",
    "agg_all_numeric",
    "agg_stacked_two_level",
    "agg_stacked_three_level",
    "agg_over_flat",
    "agg_training_filter",
    "agg_intervals",
    "agg_median",
    "agg_count_distinct",
    "count_by_category",
    "count_by_flat_category",
    "count_by_wide_category",
    "count_by_open_category",
    "count_by_window_and_part",
    "screened_distinct_counts",
    "flat_multi_hop",
    "flat_of_agg",
    "flat_one_to_one",
    "wide_read",
    "row_decile",
    "row_text_length",
    "distinct_counts",
    "infer_binary_columns",
    "one_to_one_check",
    "split_train_rows",
    "training_matrix",
    "label_encode",
    "anova_f_scores",
    "feature_quality_auc",
    "scale_standard",
    "best_so_far",
    "monthly_rollup",
    "scatter_sample",
    "cluster_assign",
    "reduce_svd",
    "model_scores",
]


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    run(spark, sf_dir, names[0])
    seconds = {name: round(run(spark, sf_dir, name), 3) for name in names}
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
