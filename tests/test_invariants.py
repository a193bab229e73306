"""Operators on a random frame: split and plain plans agree, and the basic laws hold."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronofleet.operators import catalog as ct
from chronofleet.operators import frames as fr
from chronofleet.operators import ranges as rg
from chronofleet.operators import series as se
from chronofleet.plans import interval_join as interval
from chronofleet.plans.interval_join import interval_join

NAN, INF = float("nan"), float("inf")
T0 = 1_704_067_200_000_000_000


@pytest.fixture(scope="module")
def data():
    """Two sources, three channels, repeated times, NaN, infinity and a late cluster."""
    rng = random.Random(11)
    out = []
    for i in range(400):
        ts = T0 + (10**15 if i % 5 == 0 else 0) + rng.randint(0, 120)
        value = rng.choice([NAN, INF, 1.0, 2.0, 3.0, rng.random()])
        out.append((f"s{i % 2}", rng.choice("abc"), ts, i, value))
    return out


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "source_id string, channel_id string, ts_ns bigint, seq bigint, value double").repartition(4)


def _pair(frame):
    return frame.filter("channel_id = 'a'"), frame.filter("channel_id = 'b'")


CASES = {
    "derivative": lambda f, n: se.derivative(f, target_rows=n),
    "gradient": lambda f, n: se.gradient(f, target_rows=n),
    "unwrap": lambda f, n: se.unwrap(f.filter("value < 100"), target_rows=n),
    "align_union": lambda f, n: se.align_union(f, ["a", "b", "c"], target_rows=n),
    "align_hold": lambda f, n: se.align_hold(f, ["a", "b", "c"], 7, target_rows=n),
    "align_hold_global": lambda f, n: se.align_hold(f, ["a", "b"], 7, by=[], target_rows=n),
    "table_model": lambda f, n: se.table_model(f, ["a", "b", "c"], max_rows=50, target_rows=n),
    "state_segments": lambda f, n: se.state_segments(f, T0 + 2 * 10**15, target_rows=n),
    "zip": lambda f, n: se.zip_by_index(*_pair(f), target_rows=n),
    "gps_track": lambda f, n: se.gps_track(*_pair(f), max_points=7, target_rows=n),
    "period": lambda f, n: ct.infer_period(f, 5, target_rows=n),
    "intervals": lambda f, n: rg.coalesce_intervals(
        f.select("source_id", F.col("ts_ns").alias("start_ns"), (F.col("ts_ns") + F.col("seq") % 3).alias("end_ns"), F.col("channel_id").alias("kind")), ["source_id"], target_rows=n
    ),
    "coverage": lambda f, n: fr.coverage_ranges(f.select("channel_id", F.col("seq").alias("decode_idx"), F.col("ts_ns").alias("pts_ns")), ["channel_id"], target_rows=n),
    "pacing": lambda f, n: fr.pacing_summary(f.select("source_id", F.col("ts_ns").alias("wall_ns"), (F.col("seq") * 10).alias("pts_ns"), "seq"), ["source_id"], target_rows=n).select(
        "source_id", "paints", "source_interval_ns", "p50_dwell_ms", "p95_dwell_ms", "player_err_p95_ms", "repeats", "hist_dwell"
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_split_plan_gives_the_same_rows(frame, rows, name):
    assert rows(CASES[name](frame, 9)) == rows(CASES[name](frame, 10**6))


def test_prev_adds_at_most_one_row_per_series(frame, rows):
    start, end = T0 + 60, T0 + 90
    body = rows(rg.fetch_range(frame, None, start, end))
    extra = rg.fetch_range(frame, None, start, end, include_prev=True).filter(F.col("ts_ns") < start)
    assert rows(rg.fetch_range(frame, None, start, end, include_prev=True).filter(F.col("ts_ns") >= start)) == body
    assert extra.groupBy("source_id", "channel_id").count().filter("count > 1").isEmpty()


def test_segments_tile_the_range(frame, rows):
    end = T0 + 2 * 10**15
    seg = se.state_segments(frame, end)
    span = frame.groupBy("source_id", "channel_id").agg((F.lit(end) - F.min("ts_ns")).alias("want"))
    covered = seg.groupBy("source_id", "channel_id").agg(F.sum(F.col("end_ns") - F.col("start_ns")).alias("got"))
    assert span.join(covered, ["source_id", "channel_id"]).filter("want != got").isEmpty()


def test_unbounded_hold_is_the_asof_value(frame, rows):
    held = se.align_hold(frame, ["a", "b"], 10**18).select("source_id", "ts_ns", F.col("a").alias("v"))
    finite = frame.filter("channel_id = 'a'")
    joined = rg.asof_join(held.select("source_id", "ts_ns"), finite, ["source_id"])
    v = F.col("right_value")
    want = joined.select("source_id", "ts_ns", F.when(~F.isnan(v) & (F.abs(v) != INF), v).alias("v"))
    assert rows(held) == rows(want)


@pytest.mark.parametrize("closed", [False, True])
def test_interval_join_equals_brute_force(spark, data, rows, closed):
    rng = random.Random(3)
    windows = []
    for i in range(60):
        start = T0 + rng.choice([0, 10**15]) + rng.randint(-20, 120)
        windows.append((i, rng.choice(["s0", "s1", "zz"]), start, start + rng.choice([-5, 0, 1, 3, 17, 64, 10**9, 2 * 10**15])))
    w = spark.createDataFrame(windows, "w int, source_id string, start_ns bigint, end_ns bigint")
    s = spark.createDataFrame(data, "source_id string, channel_id string, ts_ns bigint, seq bigint, value double")
    got = rows(interval_join(s, w, ["source_id"], closed=closed), "w", "seq")
    want = sorted((i, q) for i, src, a, b in windows for s2, _, t, q, _ in data if s2 == src and a <= t and (t <= b if closed else t < b))
    assert got == want


def test_interval_join_keeps_the_pairs_of_a_sample_together(spark):
    i = F.col("id")
    s = spark.range(200).select(F.lit("a").alias("source_id"), (i * 5).alias("ts_ns"), i.alias("seq"))
    w = spark.range(100).select(F.lit("a").alias("source_id"), (i * 10).alias("start_ns"), (i * 10 + 64).alias("end_ns"), i.alias("w"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = [r.seq for r in interval_join(s, w, ["source_id"]).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) > 1_000 and 1 + sum(a != b for a, b in zip(got, got[1:])) == len(set(got))


@pytest.fixture
def spread(monkeypatch):
    """Limits so small that a few pairs are many."""
    for name, value in (("FEW_WINDOWS", 0), ("TASK_PAIRS", 64), ("SIDE_BITS", 3)):
        monkeypatch.setattr(interval, name, value, raising=False)


@pytest.mark.parametrize("closed", [False, True])
def test_spread_interval_join_equals_brute_force(spark, data, rows, closed, spread):
    test_interval_join_equals_brute_force(spark, data, rows, closed)


def test_interval_join_spreads_the_pairs_of_a_slice(spark, spread):
    """All samples at one time: no slice is narrow enough to part them, and their bytes are few."""
    i = F.col("id")
    s = spark.range(300).select(F.lit("a").alias("source_id"), F.lit(7).cast("bigint").alias("ts_ns"), i.alias("seq"))
    w = spark.range(100).select(F.lit("a").alias("source_id"), (i % 7).alias("start_ns"), (i % 7 + 9).alias("end_ns"), i.alias("w"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = interval_join(s, w, ["source_id"])
        assert out.columns == ["source_id", "ts_ns", "seq", "start_ns", "end_ns", "w"]
        got = out.select("seq", "w", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == len({(r.seq, r.w) for r in got}) == 300 * 100
    per_task = Counter(r.p for r in got)
    assert len(per_task) > 100 and max(per_task.values()) < 1500


def test_slices_of_samples_only_are_parted_too(spark, spread):
    i = F.col("id")
    s = spark.range(2000).select(F.lit("a").alias("source_id"), F.when(i < 1900, 0).otherwise(i * 1000).alias("ts_ns"), i.alias("seq"))
    w = spark.createDataFrame([("a", 1_950_000, 1_950_001), ("a", -5_000_000, -4_999_999)], "source_id string, start_ns bigint, end_ns bigint")
    one = F.lit(0).alias("_bits")
    keyed, _ = interval._spread(s.select("*", one, F.col("ts_ns").alias("_slice")), w.select("*", one, F.col("start_ns").alias("_slice")), ["source_id"])
    assert keyed.count() == 2000 and keyed.groupBy("_cell").count().agg(F.max("count")).first()[0] < 150


def test_spread_interval_join_of_null_keys_and_other_key_types(spark, spread):
    s = spark.range(400).select((F.when(F.col("id") % 5 > 0, F.col("id") % 5)).cast("int").alias("k"), F.col("id").alias("ts_ns"))
    w = spark.range(100).select((F.when(F.col("id") % 4 > 0, F.col("id") % 4)).alias("k"), F.col("id").alias("start_ns"), (F.col("id") + 50).alias("end_ns"), F.col("id").alias("w"))
    got = sorted((r.k, r.ts_ns, r.w) for r in interval_join(s, w, ["k"]).collect())
    assert got == sorted((t % 5, t, i) for t in range(400) for i in range(100) if t % 5 and t % 5 == i % 4 and i <= t < i + 50)
