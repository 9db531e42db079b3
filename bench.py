"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR  folder of the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
BENCH_QUERIES comma-separated names instead of the headline list
"""

from __future__ import annotations

import json
import os
import sys
import time

from disputeflow.plans.queries import registry
from disputeflow.session import build_session

HEADLINE = [
    "risk_by_band",
    "dispute_labels",
    "feature_table",
    "filled_feature_table",
    "column_modes",
    "split_70_30",
    "threshold_sweep",
    "roc_auc",
    "model_evaluations",
    "evidence_records",
    "term_statistics",
    "retrieval_top_k",
    "review_routing",
    "investigation_reports",
    "audit_records",
    "streamed_reviews",
    "logistic_regression",
]


def scale(sf_dir: str) -> float | str:
    name = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    try:
        return float(name)
    except ValueError:
        return name


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    every = registry()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    times = {}
    for name in names:
        start = time.perf_counter()
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": scale(sf_dir),
            }
        )
    )


if __name__ == "__main__":
    main()
