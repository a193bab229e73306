"""The plans must keep the shapes that hold at scale."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry_points

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")

SERIES = sorted(n for n in entry_points.queries() if n[0] in "rdc")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SERIES)
def test_no_nested_loops_and_no_single_task_windows(spark, name):
    plan = plan_of(entry_points.queries()[name](spark, DATA))
    assert "BroadcastNestedLoopJoin" not in plan
    assert "CartesianProduct" not in plan
    lines = plan.splitlines()
    below = [lines[i + 1 : i + 4] for i, line in enumerate(lines) if "Window [" in line]
    assert not any("SinglePartition" in line for after in below for line in after)


def test_range_fetch_pushes_channel_and_reads_few_columns(spark):
    plan = plan_of(entry_points.queries()["r1_fetch_range"](spark, DATA))
    assert "In(event_type, [click,error])" in plan
    assert "props" not in plan.split("ReadSchema")[1]
    assert "Exchange" not in plan


def test_stats_aggregate_before_the_shuffle(spark):
    plan = plan_of(entry_points.queries()["d9_series_stats"](spark, DATA))
    assert "partial_min" in plan and plan.count("Exchange") == 1


def test_point_operators_do_not_shuffle(spark):
    for name in ("d1_abs_scale", "g1_explode_points", "g2_rotate_translate", "g9_box_corners", "s2_s6_unpivot_parquet", "f1_time_text", "k2_json_columns"):
        assert "Exchange" not in plan_of(entry_points.queries()[name](spark, DATA)), name


def test_scan_shuffles_once_for_two_steps(spark):
    plan = plan_of(entry_points.queries()["d4_unwrap"](spark, DATA))
    assert plan.count("Exchange hashpartitioning") == 1


def test_points_explode_inside_generated_code(spark):
    """Only then is the position array of a spin not copied for every point."""
    plan = plan_of(entry_points.queries()["g1_explode_points"](spark, DATA))
    assert any("Generate posexplode" in line and "*(" in line for line in plan.splitlines())


def test_split_scan_broadcasts_cells_and_shuffles_rows_once(spark):
    plan = plan_of(entry_points.queries()["d2_derivative_hot"](spark, "/root/testdata/sf0.01"))
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "SortMergeJoin" not in plan
    assert sum("Exchange hashpartitioning" in line and "_cell" in line and "seq" not in line for line in plan.splitlines()) <= 2


def executions(spark, build):
    """The physical plans of what runs while ``build`` makes a query."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    build()
    bus.waitUntilEmpty()
    every = store.executionsList()
    return [every.apply(i).physicalPlanDescription() for i in range(before, store.executionsCount())]


@pytest.mark.parametrize(("name", "most"), [("d2_derivative", 1), ("d2_derivative_hot", 1), ("d7_align_hold", 1), ("d8_table_model", 1), ("d12_state_segments", 1), ("c6_infer_period", 1), ("s8_profile_times", 1), ("e1_read_events", 0), ("r2_fetch_range_prev", 0), ("r4_sample_at", 0)])
def test_building_a_query_counts_at_most_once(spark, name, most):
    queries = entry_points.queries()
    assert len(executions(spark, lambda: queries[name](spark, DATA))) <= most


def test_the_lake_is_planned_from_its_histogram(spark, tmp_path, rows):
    from pyspark.sql import functions as F

    from chronofleet.operators.ranges import sample_at
    from chronofleet.operators.series import derivative
    from chronofleet.registry.common import DAY, T0, telemetry
    from chronofleet.sources.sinks import read_histogram, read_samples, write_samples

    samples, path = telemetry(spark, DATA), str(tmp_path / "lake")
    write_samples(samples, path, 8)
    lake, histogram = read_samples(spark, path, samples.schema), read_histogram(spark, path)
    assert histogram.agg(F.sum("n")).first()[0] == lake.count() == samples.count()
    found = {}
    plans = executions(spark, lambda: found.update(hot=derivative(lake, target_rows=50, histogram=histogram)))
    assert len(plans) <= 1 and all("value" not in p.split("Arguments")[0] and "_histogram" in p for p in plans)
    assert rows(found["hot"], "source_id", "channel_id", "ts_ns", "seq", "value") == rows(derivative(samples), "source_id", "channel_id", "ts_ns", "seq", "value")
    t = T0 + 15 * DAY
    assert not executions(spark, lambda: found.update(last=sample_at(lake, t, histogram=histogram)))
    assert rows(found["last"], "source_id", "channel_id", "ts_ns", "seq") == rows(sample_at(samples, t), "source_id", "channel_id", "ts_ns", "seq")
    scans = [line for line in plan_of(found["last"]).splitlines() if "FileScan" in line and "value#" in line]
    assert sum("GreaterThanOrEqual(ts_ns," in line for line in scans) == 2 and len(scans) == 3


def test_last_samples_are_hash_aggregated(spark):
    plan = plan_of(entry_points.queries()["r4_sample_at"](spark, DATA)).splitlines()
    first = max(i for i, line in enumerate(plan) if "Aggregate" in line)
    assert "HashAggregate" in plan[first] and not any("Sort " in line for line in plan[first:])


def test_no_payload_is_broadcast_by_an_asof_join(spark):
    from pyspark.sql import functions as F

    from chronofleet.operators.ranges import asof_join

    blob = F.rpad(F.col("id").cast("string"), 1 << 20, "x")
    right = spark.range(5000).select(F.lit("s").alias("s"), F.col("id").alias("ts_ns"), F.col("id").alias("seq"), blob.alias("blob"))
    left = spark.range(100).select(F.lit("s").alias("s"), (F.col("id") * 41).alias("ts_ns"), F.col("id"))
    out = asof_join(left, right, ["s"], values=["blob"], target_rows=100).select("id", "right_ts_ns", F.length("right_blob").alias("n"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the optimizer takes the made-up rows for small
    try:
        plan = plan_of(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    carried = 0
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((k for k in range(i + 1, len(lines)) if depth(lines[k]) <= depth(line)), len(lines))
            assert not any("rpad(" in x for x in lines[i:below])
            carried += any("max_by" in x for x in lines[i:below])
    assert carried and "rpad(" in plan
    got = out.collect()
    assert all(r["right_ts_ns"] == r["id"] * 41 and r["n"] == 1 << 20 for r in got) and len(got) == 100


def test_alignment_gathers_a_group_once(spark):
    for name in ("d6_align_union", "d7_align_hold", "d8_table_model"):
        assert plan_of(entry_points.queries()[name](spark, DATA)).count("Exchange hashpartitioning") == 1, name


def test_pacing_ranks_its_measures_in_one_pass(spark):
    plan = plan_of(entry_points.queries()["d15_pacing_summary"](spark, DATA))
    assert plan.count("Window [") == 1 and "Expand" not in plan


@pytest.mark.parametrize("name", ["r3_fetch_ranges", "r11_slice_events"])
def test_values_are_rounded_once_per_sample(spark, name):
    above, join, below = plan_of(entry_points.queries()[name](spark, DATA)).partition("Join")
    assert join and "round(" not in above and "round(" in below
