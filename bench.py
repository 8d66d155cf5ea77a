"""Seconds per headline query: median of warm runs, written to the no-op sink.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 2). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

# One or more queries per operator family.
HEADLINE = [
    "check_row_count", "check_null_rate", "validate_customers", "metric_rules", "run_report",
    "filter_chain", "silence", "suppress_windows", "route", "schedule_missed_runs",
    "normalize", "mask_metadata", "label", "fingerprint", "priority_score",
    "health_score", "trend", "digest", "correlation", "anomaly", "forecast", "profile_report", "trace_rollup",
    "diff_previous", "debounce", "throttle", "escalation",
    "dedupe", "quota", "backoff", "circuit_breaker", "batch", "compaction",
    "tumbling_windows", "sliding_windows", "paginate", "has_cycle_acyclic", "flagship_health",
    "stream_dedupe", "stream_tumbling", "baseline_table", "audit_log",
]
# Folds on ten times the events, half of them of one key: the key cut into chunks, and in one task.
HOT_ROWS = {"hot_dedupe_cut": 100_000, "hot_dedupe_whole": None}


def hot_dedupe(max_rows):
    from pyspark.sql import functions as F

    from tidegauge.operators import fold
    from tidegauge.sources.testdata import alert_events

    def run(spark, folder):
        copies = F.explode(F.sequence(F.lit(0), F.lit(9)))
        e = alert_events(spark, folder).select("event_id", "pipeline", "check_name", "triggered_at", copies.alias("i"))
        e = e.withColumns({
            "event_id": F.col("event_id") * 10 + F.col("i"),
            "pipeline": F.when(F.col("i") < 5, "hot").otherwise(F.col("pipeline")),
            "check_name": F.when(F.col("i") < 5, "hot").otherwise(F.col("check_name")),
        })
        return fold.dedupe(e.drop("i"), 30, max_rows=max_rows)

    return run


def main() -> None:
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from tidegauge.plans.catalog import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    wanted = sys.argv[1:] or [*HEADLINE, *HOT_ROWS]
    queries = dict(QUERIES) | {name: hot_dedupe(rows) for name, rows in HOT_ROWS.items()}
    seconds = {}
    for name in wanted:
        taken = []
        for i in range(runs + 1):
            t = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            if i:
                taken.append(time.perf_counter() - t)
        seconds[name] = round(statistics.median(taken), 3)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
