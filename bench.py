"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tenurekit.queries import QUERIES  # noqa: E402
from tenurekit.session import local_session  # noqa: E402

HEADLINE = (
    "scan_reviews",
    "tip_ids",
    "user_activity",
    "event_rank",
    "event_gaps",
    "gap_percentiles",
    "first_second_events",
    "early_churn_outcomes",
    "keep_qualifying",
    "monthly_activity",
    "user_social",
    "survival_dataset",
    "engineered_features",
    "feature_correlation",
    "feature_histograms",
    "seeded_sample",
    "concordance_index",
    "cox_enet_cv",
    "ph_test",
    "leakage_sensitivity",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
