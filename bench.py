"""Headline queries on local cores; prints one JSON line.

Each query is run on its own from the Parquet files, after an untimed run on the smallest data
(beside the data of the benchmark, if it is there), so that none is charged for start-up.
``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from vigilog.plans.queries import QUERIES
from vigilog.session import local_session

HEADLINE = [
    "rollup_service_endpoint",
    "rollup_minutes",
    "detector_status",
    "latest_detection",
    "merged_incidents",
    "validate_events",
    "accepted_lines",
    "signature_normalize",
    "signature_normalize_docs",
    "sample_diverse",
    "classification_packets",
    "injection_scan_packets",
    "commit_candidates",
    "correlation_packets",
    "parsed_commits",
    "parsed_classifications",
    "alert_messages",
    "cost_groups",
    "verdict_scoring",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in HEADLINE if os.path.isdir(small) else ["known_services"]:
        QUERIES[name](spark, small if os.path.isdir(small) else sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
