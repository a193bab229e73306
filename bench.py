"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) holds the tables, BENCH_CPUS the local cores.
Each query writes every row to the ``noop`` sink; the best of two runs counts, after one
warm-up of the session.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from chronofleet.registry import all_queries

HEADLINE = (
    "r1_fetch_range",
    "r2_fetch_range_prev",
    "r3_fetch_ranges",
    "r4_sample_at",
    "r5_snapshot",
    "r6_asof_join",
    "r11_slice_events",
    "d2_derivative",
    "d5_ego_signals",
    "d6_align_union",
    "d7_align_hold",
    "d8_table_model",
    "d9_series_stats",
    "d10_zip_by_index",
    "d12_state_segments",
    "d15_pacing_summary",
    "g1_explode_points",
    "g3_project_pinhole",
    "g5_reprojection_stats",
    "c1_channel_catalog",
    "c6_infer_period",
    "c10_channel_tree",
    "e3_upsert_events",
    "s2_s6_unpivot_parquet",
    "s7_recipe_records",
    "s22_json_scalars",
)
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("chronofleet-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries[HEADLINE[0]].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(RUNS):
            start = time.perf_counter()
            queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        timings[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {"metric": "headline_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": Path(sf_dir).name}
        )
    )


if __name__ == "__main__":
    main()
