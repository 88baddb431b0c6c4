"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_RUNS`` (default 0: one
timed run after one query that starts the JVM and Python workers; N > 0 means the median of N runs after
a warm-up run of each query).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from millrace import build_session  # noqa: E402
from millrace.plans import suite  # noqa: E402

HEADLINE = [
    "group_stats",
    "percentile_nr",
    "dist_stats",
    "time_bucket_mean",
    "resample_linear",
    "rolling_mean",
    "ewma",
    "an_zscore",
    "an_mad",
    "an_cusum",
    "an_auto",
    "fc_holt_winters",
    "backtest",
    "fc_auto",
    "lttb",
    "join_first_match",
    "join_multi_full",
    "join_asof",
    "corr_matrix",
    "dedupe_points",
    "expand_records",
    "clean_document",
    "flatten_paths",
    "validate_contract",
    "infer_fields",
    "chain_build",
    "chain_verify",
    "ingest_profile",
    "st_dedupe",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "0"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "millrace-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    suite.QUERIES["clean_document"](spark, sf).write.format("noop").mode("overwrite").save()
    for name in names:
        fn = suite.QUERIES[name]
        taken = []
        for attempt in range(runs + 1):
            begin = time.perf_counter()
            try:
                fn(spark, sf).write.format("noop").mode("overwrite").save()
            except Exception as error:  # noqa: BLE001
                print(f"{name} failed: {error}", file=sys.stderr, flush=True)
                taken = []
                break
            if attempt or runs == 0:
                taken.append(time.perf_counter() - begin)
        if not taken:
            continue
        times[name] = round(statistics.median(taken), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
