"""Time the headline queries and print one JSON line.

Each query is run once to warm up and then three times; its time is the median.
A run executes the whole plan and drops the rows.  ``BENCH_QUERIES`` (comma
separated name parts, or ``all``) picks other queries.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemark.plans import catalog
from tidemark.session import build_session

HEADLINE = [
    "b02_network_summary", "b03_station_hourly", "q01_kpi_revenue", "q03_pl_trend",
    "q06_revenue_by_segment", "q07_revenue_by_product", "q08_top_expenses",
    "q10_monthly_change", "q12_daily_row_trend", "q15_profitability_band",
    "q20_orphan_keys", "q24_latency", "q25_health", "q26_revenue_drift",
    "t01_dim_client", "t02_fact_revenue", "t03_fact_expense", "t05_fact_client_aum",
    "t08_crossref", "c01_churn_flags", "v01_kpis", "v04_category_breakdown",
    "v08_loyalty_checks", "m03_week_over_week", "g01_masked_view",
    "g03_access_review", "l01_failed_login_spikes", "j11_asof_rates",
    "w01_latest_per_key", "k02_monthly_rollup",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def seconds(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def chosen(names: list[str]) -> list[str]:
    wanted = os.environ.get("BENCH_QUERIES", "")
    if not wanted:
        return HEADLINE
    if wanted == "all":
        return names
    parts = wanted.split(",")
    return [n for n in names if any(p in n for p in parts)]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__ui__enabled="false",
        spark__driver__memory="16g", spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    times: dict[str, float] = {}
    for name in chosen(sorted(queries)):
        def run(query=queries[name]):
            return query(spark, folder)

        seconds(run)
        times[name] = round(statistics.median(seconds(run) for _ in range(RUNS)), 4)
    print(
        json.dumps(
            {
                "metric": "headline queries, median warm run, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
