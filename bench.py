"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion with all its columns (no rows are sent to the driver). One query
warms the session up; the time of a query is the better of two runs.
"""

from __future__ import annotations

import json
import os
import time

from payscope.plans.queries import QUERIES
from payscope.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "filings_match",
    "filings_canonical",
    "coerce_good",
    "csv_filings",
    "manifest_rows",
    "manifest_counts",
    "upsert_latest",
    "upsert_merge",
    "q_totals",
    "q_by_specialty",
    "fact_top_specialty",
    "fact_share",
    "user_union",
    "querylog_screen",
    "series_grouping_sets",
    "naive_holdout",
    "hw_forecast",
    "model_choice",
    "forecast_run",
    "did_estimate",
    "claims_numbers",
    "claims_verdicts",
    "claims_answers",
    "eval_scores",
    "canary_scores",
    "canary_latency",
    "stream_upsert",
    "stream_quarter_totals",
]


def run_once(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, partitions=int(CPUS), app="payscope-bench")
    run_once(spark, HEADLINE[0])
    times = {name: round(min(run_once(spark, name) for _ in range(2)), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
