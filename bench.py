"""Time the headline queries; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8), ``BENCH_RUNS`` (timed runs per query after one warm-up, default
1; the median is reported).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from driver_queries.spark_queries import QUERIES
from limnokit.session import build_session

HEADLINE = [
    "ols_by_group",
    "ols_pvalues",
    "mm_fit",
    "group_stats_attach",
    "baseline_delta",
    "box_stats",
    "mm_fit_continuous",
    "daily_delta",
    "loess_grid",
    "hist_bins",
    "profile",
    "rule_report",
    "sig_share",
    "sig_rollup",
    "trim_head",
    "uptake_rate_table",
    "incubation_lines",
    "incubation_curves",
    "saturating_share",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: {seconds[name]} s (first {times[0]:.2f} s)", file=sys.stderr)
    spark.stop()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name,
        "cpus": int(cpus),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
