"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR   folder with the Parquet tables (default /root/testdata/sf0.1)
    BENCH_CPUS     cores of the local session (default: all)

Every query runs once to warm up and then counts with the better of two runs. Results are computed
in full and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")

from pyspark.sql import SparkSession  # noqa: E402

from liftpanel.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "target_daily",
    "target_out_perimeter",
    "control_daily",
    "click_daily",
    "interest_smoothed",
    "exog_smoothed",
    "features_long",
    "features_wide",
    "clean_features",
    "target_acf",
    "target_pacf",
    "target_corr",
    "weekly_seasonal",
    "standardized",
    "effect_summary",
    "effect_report",
    "qq_points",
    "nation_effect_summary",
    "panel_runs",
]
REPEATS: dict[str, int] = {}


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("liftpanel bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        seconds(spark, name, sf_dir)
        times[name] = round(min(seconds(spark, name, sf_dir) for _ in range(REPEATS.get(name, 2))), 3)
        print(f"{name:28s} {times[name]:8.3f}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, best run after warm-up",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
