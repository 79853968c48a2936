"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the cores. Every query runs once to warm up and is then
timed; results go to Spark's no-op sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import time

from gallery import QUERIES
from shelfwise.session import local_session

HEADLINE = [
    "daily_demand",
    "window_units",
    "rolling_units_per_event",
    "recent_rate_average",
    "full_evaluation",
    "decoded_changes",
    "silver_events",
    "deduplicated_movements",
    "current_balance",
    "stale_balance_flags",
    "ledger_balances",
    "sales_statistics",
    "nearest_rank_percentiles",
    "stock_availability",
    "order_status_replay",
    "orders_of_users",
    "semantic_top_k",
    "catalog_facets",
    "event_calendar",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, partitions=max(int(cpus), 1) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
