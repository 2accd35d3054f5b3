"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from solea.plans import QUERIES
from solea.session import local_session

HEADLINE = (
    "rank_runs", "auc_rank", "mean_threshold_compare", "threshold_sweep", "delong_test", "mcnemar_all", "bootstrap_ci",
    "zone_stats", "thermal_feature_matrix", "risk_scoring", "raw_form_export", "case_status", "commit_manifest", "early_stop",
    "grouped_stratified_folds", "clahe", "connected_components", "footprint_indices", "pointing_game", "stream_audit_counts",
)


def main() -> None:
    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or list(HEADLINE)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["confusion_counts"](spark, data).write.format("noop").mode("overwrite").save()  # start-up is not measured
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": data.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
