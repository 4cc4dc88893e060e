"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_ONLY     comma-separated name prefixes, to time a few
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from gaugeflow.model import CheckerConfig, Requirement
from gaugeflow.operators import windows
from gaugeflow.operators.rules import check_rows
from gaugeflow.plans import all_queries
from gaugeflow.plans.feature_queries import event_readings
from gaugeflow.plans.registry import derived
from gaugeflow.plans.rule_queries import RULE_ROWS

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REGISTERED = [
    "r12_event_rows", "r01_all_rules", "r11_rule_functions", "r19_rules_as_rows", "w03_value_at_clock_offset", "w16_clock_window_mean",
    "w22_wide_assembly", "t03_interval", "t09_requirements", "v01_parse_answers", "v05_resolve_times", "v06_verify_rules", "v08_rule_batches",
    "v12_consolidation_summary", "d01_chunks", "d05_sync_totals", "d06_top_k", "d07_contexts", "c03_rule_stats", "c08_rule_detail",
    "c13_cascade_delete", "c14_job_progress", "s05_sensor_upsert", "s07_load_rules", "x01_stream_features", "x04_stream_events",
]


def window(minutes: int, statistic: str, **config):
    req = Requirement("any", f"{minutes}m:", statistic)
    return lambda spark, folder: windows.features(event_readings(spark, folder), [req], CheckerConfig(**config))


def rules(count: int):
    """So many rules held as rows, of two conditions each."""

    def run(spark, folder):
        rows = derived(spark, folder, RULE_ROWS, "part").where(f"rule_id <= {count}")
        return check_rows(event_readings(spark, folder), rows, align=False, snapshot=False)

    return run


def cases() -> dict:
    out = {
        f"window_{minutes}_{statistic}": window(minutes, statistic)
        for statistic in ("mean", "max", "std", "quantile")
        for minutes in (10, 100, 1440)
    }
    out["window_1440_mean_sliding"] = window(1440, "mean", wide_window=10_000)
    out["window_100_mean_split"] = window(100, "mean", layout="split", max_task_rows=40_000)
    out |= {f"rules_{count}": rules(count) for count in (3, 100, 1000)}
    queries = all_queries()
    return out | {name: queries[name] for name in REGISTERED}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("gaugeflow-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = tuple(p for p in os.environ.get("BENCH_ONLY", "").split(",") if p)
    window(10, "mean")(spark, SF_DIR).write.format("noop").mode("overwrite").save()  # start the JVM's work before timing
    seconds = {}
    for name, run in cases().items():
        if only and not name.startswith(only):
            continue
        begin = time.perf_counter()
        run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
