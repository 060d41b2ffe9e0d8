"""Time the headline queries: one JSON line with the seconds of each.

Every query is planned and run to the end into Spark's no-op sink, so all rows and columns
are computed and none is collected. One query runs first, untimed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from flowquarry.plans import QUERIES
from flowquarry.session import build_session

HEADLINE = [
    "prototype_confusion", "parse_source_name", "valid_labels", "impute_median", "impute_mode", "interaction_features",
    "reindex_features", "standardize", "class_profile", "class_prototypes", "class_weights", "mutual_information",
    "feature_correlation", "stratified_time_split", "stratified_split", "count_windows", "row_blocks", "last_n_alerts",
    "score_batch", "baseline_deviation", "dual_explanation", "linear_shap", "top_features", "sampled_shapley",
    "counterfactual_random", "classification_report", "outcome_stats", "enrich_alerts", "route_alerts", "alert_cooldown",
    "sliding_rate", "knn_within_class", "smote", "train_classifier", "stream_score", "stream_rate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(cores, cores)
    QUERIES["valid_labels"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up, not timed
    seconds: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "scored_rows_per_second": round(rows / seconds["score_batch"]) if "score_batch" in seconds else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
