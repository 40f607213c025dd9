"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and then three times; the best run counts. Building the
DataFrame is part of the time, as some queries stage a table while they are built.
"""

from __future__ import annotations

import json
import os
import time

from casepulse.plans.registry import queries
from casepulse.session import get_spark

HEADLINE = (
    "client_day_counts",
    "daily_client_cases",
    "modality_sla_summary",
    "client_activity",
    "churn_tiers",
    "silent_contacts",
    "zero_cases_today",
    "same_weekday_drop",
    "same_weekday_hourly",
    "weekday_interval_baseline",
    "steady_client_comparison",
    "trend_report",
    "contact_directory",
    "reachable_contacts",
    "message_outbox",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        f"local[{cpus}]", "bench", **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs[1:]), 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
