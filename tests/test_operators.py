"""Literal cases for range, series, frame, catalog, event and spatial operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from chronofleet.functions import time as tm
from chronofleet.operators import catalog as ct
from chronofleet.operators import events as ev
from chronofleet.operators import frames as fr
from chronofleet.operators import ranges as rg
from chronofleet.operators import series as se
from chronofleet.operators import spatial as sp

NAN, INF = float("nan"), float("inf")
BIG = 2**53 + 1


# -- ranges ----------------------------------------------------------------------
def test_range_includes_start_excludes_end(series, rows):
    s = series({"a": [(10, 1), (20, 2), (30, 3)]})
    assert rows(rg.fetch_range(s, ["a"], 10, 30), "ts_ns") == [(10,), (20,)]
    assert rows(rg.fetch_range(s, ["a"], 20, 30, include_prev=True), "ts_ns") == [(10,), (20,)]
    assert rows(rg.fetch_range(s, ["a"], 25, 25, include_prev=True), "ts_ns") == [(20,)]
    assert rows(rg.fetch_range(s, ["a"], 30, 5, include_prev=True), "ts_ns") == [(20,)]
    assert rows(rg.fetch_range(s, ["a"], 5, 8, include_prev=True)) == []


def test_prev_is_one_row_of_the_last_duplicate(series, rows):
    s = series({"a": [(10, 1), (10, 2), (20, 3)]})
    assert rows(rg.fetch_range(s, ["a"], 15, 16, include_prev=True), "ts_ns", "value") == [(10, 2.0)]


def test_sample_at_keeps_exact_ns(series, rows):
    s = series({"a": [(BIG, 1), (BIG + 1, 2)], "b": [(BIG + 5, 3)]})
    assert rows(rg.sample_at(s, BIG), "channel_id", "value") == [("a", 1.0)]


def test_many_windows_of_mixed_length(series, spark, rows):
    s = series({"a": [(t, t) for t in range(0, 1000, 10)]})
    w = spark.createDataFrame([("w1", "a", 0, 1000), ("w2", "a", 55, 56), ("w3", "a", 30, 60), ("w4", "a", 60, 30), ("w5", "z", 0, 100)], "w string, channel_id string, start_ns bigint, end_ns bigint")
    got = rg.fetch_ranges(s, w, ["channel_id"]).groupBy("w").count()
    assert rows(got) == [("w1", 100), ("w3", 3)]


def test_no_windows(series, spark):
    s = series({"a": [(1, 1)]})
    w = spark.createDataFrame([], "channel_id string, start_ns bigint, end_ns bigint")
    assert rg.fetch_ranges(s, w, ["channel_id"]).isEmpty()


def test_event_slice_is_closed(series, spark, rows):
    s = series({"a": [(10, 1), (20, 2), (30, 3)]})
    e = spark.createDataFrame([("log", 20, 10, 0), ("log", 30, 0, 0)], "source_id string, ns bigint, before_ns bigint, after_ns bigint")
    assert rows(rg.slice_events(s, e), "ns", "ts_ns") == [(20, 10), (20, 20), (30, 30)]


def test_offsets_shift_and_exempt_video(series, spark, rows):
    s = series({"a": [(10, 1), (20, 2)]}, "x").unionByName(series({"v": [(10, 1), (20, 2)]}, "y"))
    src = spark.createDataFrame([("x", "tabular", 100), ("y", "video", 100)], "source_id string, kind string, time_offset_ns bigint")
    assert rows(rg.fetch_range_with_offsets(s, src, 110, 120), "source_id", "ts_ns") == [("x", 110)]
    assert rows(rg.apply_offsets(s, src), "source_id", "ts_ns") == [("x", 110), ("x", 120), ("y", 10), ("y", 20)]


def test_intervals_merge_only_on_overlap(spark, rows):
    data = [("g", 0, 10, "head"), ("g", 10, 20, "mid"), ("g", 15, 30, "tail"), ("g", 40, 40, "none"), ("g", -5, 2, "early"), ("g", 95, 200, "late")]
    df = spark.createDataFrame(data, "g string, start_ns bigint, end_ns bigint, kind string")
    want = [("g", 0, 10, "early"), ("g", 10, 30, "mid"), ("g", 95, 100, "late")]
    got = rows(rg.coalesce_intervals(df, ["g"], 0, 100))
    assert [r[:3] for r in got] == [r[:3] for r in want] and got[1][3] == "mid"
    assert rows(rg.coalesce_intervals(df, ["g"], 0, 100, target_rows=2)) == got


# -- transforms ------------------------------------------------------------------
def test_derivative_gaps(series, rows):
    s = series({"a": [(0, 1), (10**9, 3), (10**9, 9), (3 * 10**9, 13)], "b": [(5, 1)]})
    assert rows(se.derivative(s), "channel_id", "seq", "value") == [("a", 0, "nan"), ("a", 1, 2.0), ("a", 2, "nan"), ("a", 3, 2.0), ("b", 0, "nan")]


def test_derivative_after_nan_is_nan(series, rows):
    s = series({"a": [(0, 1), (10**9, NAN), (2 * 10**9, 5), (3 * 10**9, 6)]})
    assert rows(se.derivative(s), "seq", "value") == [(0, "nan"), (1, "nan"), (2, "nan"), (3, 1.0)]


def test_gradient_matches_the_uneven_rule(series, rows):
    import numpy as np

    t = [0.0, 1.0, 1.5, 4.0, 4.25]
    y = [0.0, 2.0, -1.0, 5.0, 7.0]
    s = series({"a": [(int(a * 1e9), b) for a, b in zip(t, y)]})
    got = [v for _, v in rows(se.gradient(s, target_rows=2), "seq", "value")]
    assert got == pytest.approx(np.gradient(y, t))


def test_unwrap_matches_reference_rule(series, rows):
    import numpy as np

    y = [0.0, 3.0, -3.0, -0.5, 3.1, -3.1, 2.9, 2.9 + 2 * math.pi]
    s = series({"a": list(enumerate(y))})
    got = [v for _, v in rows(se.unwrap(s, target_rows=3), "seq", "value")]
    assert got == pytest.approx(np.unwrap(y))


# -- alignment -------------------------------------------------------------------
def test_union_pairs_duplicates_by_occurrence(series, rows):
    s = series({"a": [(1, 1), (2, 2), (2, 3)], "b": [(2, 20), (3, INF)]})
    want = [(1, 1.0, None), (2, 2.0, 20.0), (2, 3.0, None), (3, None, None)]
    assert sorted(rows(se.align_union(s, ["a", "b"]), "ts_ns", "a", "b"), key=str) == sorted(want, key=str)


def test_union_of_disjoint_channels(series, rows):
    s = series({"a": [(1, 1)], "b": [(9, 2)]})
    assert rows(se.align_union(s, ["a", "b", "c"]), "ts_ns", "a", "b", "c") == [(1, 1.0, None, None), (9, None, 2.0, None)]


def test_hold_until_threshold_then_gap(series, rows):
    s = series({"a": [(0, 1), (100, 2)], "b": [(0, 5), (10, 6), (60, 7)]})
    got = rows(se.align_hold(s, ["a", "b"], 10), "ts_ns", "a", "b")
    assert got == [(0, 1.0, 5.0), (10, 1.0, 6.0), (11, None, 6.0), (20, None, 6.0), (21, None, None), (60, None, 7.0), (100, 2.0, None)]


def test_gap_equal_to_threshold_is_held(series, rows):
    s = series({"a": [(0, 1), (10, 2)]})
    assert rows(se.align_hold(s, ["a"], 10), "ts_ns", "a") == [(0, 1.0), (10, 2.0)]


def test_hold_shows_non_finite_as_gap_and_last_duplicate(series, rows):
    s = series({"a": [(0, 1), (0, 2), (5, NAN)], "b": [(6, 1)]})
    assert rows(se.align_hold(s, ["a", "b"], 100), "ts_ns", "a", "b") == [(0, 2.0, None), (5, None, None), (6, None, 1.0)]


@pytest.mark.parametrize("threshold", [None, 0, -1, INF, NAN])
def test_unusable_threshold_is_union(series, rows, threshold):
    s = series({"a": [(0, 1), (50, 2)], "b": [(0, 5)]})
    assert rows(se.align_hold(s, ["a", "b"], threshold)) == rows(se.align_union(s, ["a", "b"]))


def test_table_holds_and_marks_exact(series, rows):
    s = series({"a": [(0, 1), (10, 2), (10, 3)], "b": [(5, NAN)]})
    got = rows(se.table_model(s, ["a", "b"]), "ts_ns", "a", "a__exact", "b", "b__exact", "truncated")
    assert got == [(0, 1.0, True, None, False, False), (5, 1.0, False, "nan", True, False), (10, 3.0, True, "nan", False, False)]


def test_table_cap(series, rows):
    s = series({"a": [(i, i) for i in range(10)]})
    assert rows(se.table_model(s, ["a"], max_rows=4), "ts_ns", "truncated") == [(i, True) for i in range(4)]
    assert rows(se.table_model(s, ["a"], by=[], max_rows=10), "ts_ns", "truncated") == [(i, False) for i in range(10)]


def test_any_number_of_channels_aligns(series):
    names = [f"c{i}" for i in range(17)]
    s = series({c: [(0, i), (5, i)] for i, c in enumerate(names)})
    assert se.align_union(s, names).count() == 2
    assert [tuple(r[c] for c in names) for r in se.align_hold(s, names, 10).orderBy("ts_ns").collect()][0] == tuple(range(17))
    with pytest.raises(ValueError):
        se.align_union(s, [])


def test_table_keeps_all_rows(spark):
    s = spark.range(600_000).selectExpr("'log' AS source_id", "'a' AS channel_id", "id AS ts_ns", "id AS seq", "cast(id AS double) AS value")
    assert se.table_model(s, ["a"]).count() == 600_000


def test_open_window_takes_everything(series):
    s = series({"a": [(-5, 1), (0, 2), (2**62, 3)]})
    w = s.sparkSession.createDataFrame([("a", -(2**63), 2**63 - 1, 1), ("a", 0, 1, 2), ("a", 2**62, 2**63 - 1, 3)], "channel_id string, start_ns bigint, end_ns bigint, w int")
    got = sorted((r.w, r.ts_ns) for r in rg.fetch_ranges(s, w, ["channel_id"]).collect())
    assert got == [(1, -5), (1, 0), (1, 2**62), (2, 0), (3, 2**62)]
    assert rg.fetch_ranges(s, w, ["channel_id"], closed=True).filter("w = 2").count() == 1


def test_deep_leaves_are_found():
    from pyspark.sql import types as T

    from chronofleet.sources.messages import leaf_paths

    t = T.DoubleType()
    for i in range(21):
        t = T.StructType([T.StructField(f"d{i}", t), T.StructField("s", T.StringType())])
    assert [p.count(".") for p, _ in leaf_paths(t)] == [20]


# -- segments and tracks ---------------------------------------------------------
def test_segments(series, rows):
    s = series({"a": [(0, 1), (1, 1), (2, 2), (3, NAN), (4, INF), (5, -INF), (6, 2)]})
    want = [(0, 2, 1.0), (2, 3, 2.0), (3, 6, None), (6, 99, 2.0)]
    assert rows(se.state_segments(s, 99), "start_ns", "end_ns", "value") == want
    assert rows(se.state_segments(s, 99, target_rows=2), "start_ns", "end_ns", "value") == want
    at = se.state_at(se.state_segments(s, 99), 4)
    assert rows(at, "start_ns", "value") == [(3, None)]


def test_segments_of_all_nan_and_empty(series, rows):
    s = series({"a": [(0, NAN), (1, NAN)]})
    assert rows(se.state_segments(s, 5), "start_ns", "end_ns", "value") == [(0, 5, None)]
    assert se.state_segments(series({"a": [(0, 1)]}).limit(0), 5).isEmpty()


def test_stats_of_finite_values(series, rows):
    s = series({"a": [(0, NAN), (1, 2), (2, 4), (3, INF)], "b": [(0, NAN)]})
    assert rows(se.series_stats(s), "channel_id", "min_value", "max_value", "mean_value", "sample_count") == [("a", 2.0, 4.0, 3.0, 4), ("b", "nan", "nan", "nan", 1)]


def test_closed_form_signals(spark, rows):
    """A 0.5 Hz sine at 100 Hz for 10 s peaks at exactly one."""
    df = spark.range(1000).select(F.lit("s").alias("source_id"), F.lit("speed").alias("channel_id"), (F.col("id") * 10_000_000).alias("ts_ns"), F.col("id").alias("seq"), F.sin(2 * math.pi * F.col("id") / 200).alias("value"))
    (lo, hi, n) = rows(se.series_stats(df), "min_value", "max_value", "sample_count")[0]
    assert (round(lo, 9), round(hi, 9), n) == (-1.0, 1.0, 1000)
    assert rows(ct.infer_period(df, 1), "period_ns") == [(10_000_000,)]


def test_zip_stops_at_the_shorter(series, rows):
    a, b = series({"a": [(0, 1), (1, 2), (2, 3)]}), series({"b": [(7, 10), (8, 20)]})
    assert rows(se.zip_by_index(a, b), "idx", "ts_ns", "a", "b") == [(0, 0, 1.0, 10.0), (1, 1, 2.0, 20.0)]


def test_track_keeps_the_tail(series, rows):
    lat = series({"lat": [(i, i) for i in range(10)]})
    lon = series({"lon": [(i, NAN if i == 4 else -i) for i in range(10)]})
    got = [r[0] for r in rows(se.gps_track(lat, lon, max_points=4), "idx")]
    assert got == [0, 3, 6, 9]
    assert [r[0] for r in rows(se.gps_track(lat, lon, max_points=5), "idx")] == [0, 2, 6, 8, 9]
    same = series({"lat": [(i, 1) for i in range(4)]}), series({"lon": [(i, 1) for i in range(4)]})
    assert [r[0] for r in rows(se.gps_track(*same, max_points=2), "idx")] == [0, 2]


def test_ego_signals_on_a_straight_line(spark, rows):
    df = spark.createDataFrame([("s", i * 10**9, i, 2.0 * i, 0.0, 1.0, 0.0, 0.0, 0.0) for i in range(5)], "source_id string, ts_ns bigint, seq bigint, x double, y double, qw double, qx double, qy double, qz double")
    assert rows(se.ego_signals(df), "speed", "yaw_rate_dps", "accel") == [(2.0, 0.0, 0.0)] * 5


# -- frames ----------------------------------------------------------------------
def _frames(spark, pts, keys):
    return spark.createDataFrame([("v", i, p, i in keys) for i, p in enumerate(pts)], "channel_id string, decode_idx bigint, pts_ns bigint, is_key boolean")


@pytest.mark.parametrize(("t", "want"), [(5, (-1, 2)), (10, (0, 2)), (35, (2, 2)), (99, (5, 4))])
def test_keyframes(spark, rows, t, want):
    f = _frames(spark, [10, 20, 30, 40, 50, 60], {2, 4})
    assert rows(fr.keyframe_at(f, t, ["channel_id"]), "frame_idx", "key_idx") == [want]


def test_no_keyframe(spark, rows):
    f = _frames(spark, [10, 20], set())
    assert rows(fr.keyframe_at(f, 15, ["channel_id"]), "frame_idx", "key_idx") == [(0, -1)]
    assert fr.frames_from(f, 15, ["channel_id"]).isEmpty()


def test_decode_run(spark, rows):
    f = _frames(spark, [10, 20, 30, 40], {1, 3})
    assert rows(fr.frames_from(f, 35, ["channel_id"]), "pts_ns") == [(20,), (30,), (40,)]
    assert rows(fr.frames_from(f, 0, ["channel_id"]), "pts_ns") == [(20,), (30,), (40,)]


def test_coverage_uses_the_span_of_a_run(spark, rows):
    f = _frames(spark, [10, 40, 20, 30, 70, 80], set()).filter(F.col("decode_idx") != 4)
    assert rows(fr.coverage_ranges(f, ["channel_id"]), "start_ns", "end_ns") == [(10, 41), (80, 81)]


def test_presentation_remap(spark, rows):
    f = spark.createDataFrame([("v", 0, 0), ("v", 1, 3), ("v", 2, 1), ("v", 3, 2)], "channel_id string, decode_idx bigint, composition bigint")
    side = spark.createDataFrame([("v", i, 100 + i) for i in range(4)], "channel_id string, frame bigint, ts_ns bigint")
    assert rows(fr.remap_presentation(f, side, ["channel_id"]), "decode_idx", "pts_ns") == [(0, 100), (1, 103), (2, 101), (3, 102)]
    decode = spark.createDataFrame([("v", i, t) for i, t in enumerate([100, 103, 101, 102])], "channel_id string, frame bigint, ts_ns bigint")
    assert rows(fr.remap_presentation(f, decode, ["channel_id"]), "decode_idx", "pts_ns") == [(0, 100), (1, 103), (2, 101), (3, 102)]


def test_steady_pacing_is_smooth(spark, rows):
    data = [("p", i * 33_333_333, i * 33_333_333, i) for i in range(61)] + [("q", 0, 0, 0), ("q", 1, 1, 1)]
    tr = spark.createDataFrame(data, "p string, wall_ns bigint, pts_ns bigint, seq bigint")
    got = rows(fr.pacing_summary(tr, ["p"]), "p", "paints", "source_interval_ns", "repeats", "smooth", "hist_dwell")
    assert got == [("p", 61, 33_333_333, 0, True, [0, 0, 0, 60, 0, 0, 0]), ("q", 2, 0, 0, False, [0] * 7)]


# -- catalog ---------------------------------------------------------------------
def test_period_is_the_upper_median_of_positive_gaps(series, rows):
    s = series({"a": [(0, 1), (10, 1), (10, 1), (30, 1), (60, 1), (100, 1)], "b": [(5, 1)], "c": [(5, 1), (5, 2)]})
    for target in (None, 2):
        assert rows(ct.infer_period(s, 77, target_rows=target), "channel_id", "period_ns") == [("a", 30), ("b", 77), ("c", 77)]


def test_unique_sources_skip_taken_numbers(spark, rows):
    names = ["a", "a", "b", "a (2)", "a", "b", "a (2)"]
    df = spark.createDataFrame(list(enumerate(names)), "ord bigint, name string")
    got = dict(rows(ct.dedupe_source_ids(df), "ord", "source_id"))
    assert got == {0: "a", 1: "a (3)", 2: "b", 3: "a (2)", 4: "a (4)", 5: "b (2)", 6: "a (2) (2)"}


def test_display_names(spark, rows):
    df = spark.createDataFrame([("f", "s", 0, 1), ("f", "s", 1, 1), ("f", "s", 1, 2), ("f", "t", 0, 2), ("f", "s #0", 0, 0)], "source_id string, name string, g int, c int")
    assert rows(ct.disambiguate_names(df), "g", "c", "display_name") == [(0, 0, "s #0"), (0, 1, "s #0/1"), (0, 2, "t"), (1, 1, "s #1"), (1, 2, "s #1/2")]


def test_tree_counts_leaves(spark, rows):
    df = spark.createDataFrame([("1", "/a", None), ("2", "/a/b", None), ("3", "rpm", "Power"), ("4", "/", None)], "channel_id string, name string, group string")
    got = rows(ct.channel_tree(df), "key", "leaf_count", "is_branch", "channel_id")
    assert got == [("4", 1, False, "4"), ("Power", 1, True, None), ("Power/rpm", 1, False, "3"), ("a", 2, True, "1"), ("a/b", 1, False, "2")]
    assert ct.search_channels(df, "  ").count() == 4
    assert rows(ct.search_channels(df, "POWER"), "channel_id") == [("3",)]


def test_global_range_skips_config_and_empty(spark, rows):
    df = spark.createDataFrame([("tabular", 5, 9), ("calibration", 0, 100), ("tabular", 3, 3), ("mcap", 7, 20)], "kind string, start_ns bigint, end_ns bigint")
    assert rows(ct.global_range(df)) == [(5, 20)]
    assert rows(ct.global_range(df.limit(0))) == [(None, None)]


def test_lateral_is_no_latitude(spark, rows):
    df = spark.createDataFrame([("s", "1", "imu/accel_lateral", "scalar", 1), ("s", "2", "gps/lat", "scalar", 2), ("s", "3", "gps/lng", "scalar", 3), ("s", "4", "mode", "enum", 4)], "source_id string, channel_id string, name string, kind string, ord int")
    assert rows(ct.group_channels(df), "channel_id", "panel", "group_key") == [("1", "plot", "imu"), ("2", "map_lat", None), ("3", "map_lon", None), ("4", "enum", None)]


# -- events ----------------------------------------------------------------------
def test_event_import_rules(spark, rows):
    docs = [
        ("bare", '[{"ns":"5"},{"ns":7,"id":"x","label":" hi "},{"ns":"8","id":"x","confidence":0.5,"origin":"agent"}]'),
        ("wrap", '{"version":2,"bookmarks":[{"ns":"9007199254740993","beforeNs":"3","tags":{"a":"b"}}]}'),
        ("bad_tag", '[{"ns":"1"},{"ns":"2","tags":{"a":1}}]'),
        ("bad_ns", '[{"ns":1.5}]'), ("bad_neg", '[{"ns":1,"afterNs":-1}]'), ("bad_conf", '[{"ns":1,"confidence":2}]'), ("bad_json", "{"), ("bad_shape", '{"x":1}'), ("empty", "[]"),
    ]
    ok, rejected = ev.parse_events(spark.createDataFrame(docs, "source_id string, doc string"), now_ms=11)
    assert rows(rejected) == [("bad_conf",), ("bad_json",), ("bad_neg",), ("bad_ns",), ("bad_shape",), ("bad_tag",)]
    got = rows(ok, "source_id", "ns", "before_ns", "label", "origin", "confidence", "created_at")
    assert got == [("bare", 5, 0, "event", "user", None, 11), ("bare", 7, 0, "hi", "user", None, 11), ("bare", 8, 0, "event", "agent", 0.5, 11), ("wrap", 9007199254740993, 3, "event", "user", None, 11)]
    assert [r[0] for r in rows(ok.filter("source_id = 'bare' and ns > 5"), "id")] == ["x", "x_2"]


def test_export_imports_again(spark, rows):
    docs = [("d", '[{"id":"a","ns":"5","label":"q\\"x","color":"#111","createdAt":3,"tags":{"k":"v"},"confidence":0.25}]')]
    one, _ = ev.parse_events(spark.createDataFrame(docs, "source_id string, doc string"))
    again = ev.export_events(one).select(F.lit("d").alias("source_id"), F.concat(F.lit("["), "json", F.lit("]")).alias("doc"))
    two, rejected = ev.parse_events(again)
    assert rejected.isEmpty() and rows(two) == rows(one)


@pytest.mark.parametrize("many", [10, 6000])
def test_taxonomies_of_any_size_prune_the_same(spark, rows, many):
    data = [("s1", "e1", {"a": "1", "gone": "2"}), ("s2", "e1", {"b": "2"}), ("s2", "e1", {"a": "3"}), ("s1", "e2", {}), ("s1", "e3", None)]
    events = spark.createDataFrame(data, "source_id string, id string, tags map<string,string>")
    attrs = spark.createDataFrame([("a",), ("b",)] + [(f"k{i}",) for i in range(many)], "id string")
    got = sorted((s, i, str(t)) for s, i, t in ((r.source_id, r.id, r.tags) for r in ev.prune_tags(events, attrs).collect()))
    assert got == sorted([("s1", "e1", "{'a': '1'}"), ("s2", "e1", "{'b': '2'}"), ("s2", "e1", "{'a': '3'}"), ("s1", "e2", "{}"), ("s1", "e3", "None")])


def test_edits_and_merges_stay_within_their_source(spark):
    schema = "source_id string, id string, ord long, ns long, before_ns long, after_ns long, label string, tags map<string,string>"
    base = spark.createDataFrame([("s1", "e1", 0, 5, 0, 0, "one", {}), ("s2", "e1", 0, 6, 0, 0, "two", {})], schema)
    edits = spark.createDataFrame([(1, "s1", "e1", "delete", None, None, None, None)], "seq long, source_id string, id string, op string, attr string, value string, before_ns long, after_ns long")
    assert [(r.source_id, r.label) for r in ev.edit_events(base, edits).collect()] == [("s2", "two")]
    new = spark.createDataFrame([("s2", "e1", 0, 7, 0, 0, "new", {}), ("s2", "e1", 1, 8, 0, 0, "newer", {}), ("s3", "e1", 2, 9, 0, 0, "add", {}), ("s3", "e1", 3, 9, 0, 0, "twice", {})], schema)
    got = sorted((r.source_id, r.label, r.status, r.block, r.ord) for r in ev.upsert_events(base, new).collect())
    assert got == [("s1", "one", "kept", 0, 0), ("s2", "newer", "updated", 0, 0), ("s3", "add", "added", 1, 2), ("s3", "twice", "added", 1, 3)]


def test_two_sources_do_not_mix(spark):
    f = spark.createDataFrame([(s, "c", i, i * 10, True) for s in "ab" for i in range(2)], "source_id string, channel_id string, decode_idx long, pts_ns long, is_key boolean")
    assert fr.keyframe_at(f, 100).count() == 2 and fr.coverage_ranges(f).count() == 2
    pts = spark.createDataFrame([(s, "c", 1, i, 0.0, 0.0, 0.0, 1) for s in "ab" for i in range(4)], "source_id string, channel_id string, ts_ns long, point_idx int, x double, y double, z double, intensity int")
    assert sp.subsample_points(pts, 3, 1).count() == 6


# -- geometry --------------------------------------------------------------------
CAMERA = "source_id string, name string, model string, intrinsics array<double>, resolution array<int>, distortion array<double>, forward_poly array<double>, translation array<double>, quaternion array<double>"


def test_projection_cases(spark, rows):
    cam = spark.createDataFrame([("s", "c", "pinhole", [900.0, 900.0, 640.0, 360.0], [1280, 720], [], [], [0.0] * 3, [0.0, 0.0, 0.0, 1.0])], CAMERA)
    pts = spark.createDataFrame([("s", 0, 0.0, 0.0, 5.0), ("s", 1, 1.0, 0.0, 10.0), ("s", 2, 0.0, 0.0, -1.0), ("s", 3, 0.0, 0.0, 0.0), ("s", 4, 50.0, 0.0, 1.0), ("other", 5, 0.0, 0.0, 1.0)], "source_id string, point_idx int, x double, y double, z double")
    got = rows(sp.project_points(pts, cam), "point_idx", "u", "v", "visible")
    assert got == [(0, 640.0, 360.0, True), (1, 730.0, 360.0, True), (2, "nan", "nan", False), (3, "nan", "nan", False), (4, 45640.0, 360.0, False)]


def test_ftheta_centre_and_cull(spark, rows):
    cam = spark.createDataFrame([("s", "c", "ftheta", [0.0, 0.0, 100.0, 100.0], [200, 200], [], [0.0, 100.0, 0.0, -100.0], [0.0] * 3, [0.0, 0.0, 0.0, 1.0])], CAMERA)
    pts = spark.createDataFrame([("s", 0, 0.0, 0.0, 1.0), ("s", 1, 0.1, 0.0, 1.0), ("s", 2, 5.0, 0.0, 1.0)], "source_id string, point_idx int, x double, y double, z double")
    got = rows(sp.project_points(pts, cam), "point_idx", "u", "visible")
    th = math.atan2(0.1, 1.0)
    assert got[0] == (0, 100.0, True) and got[1][1] == pytest.approx(100 + 100 * th - 100 * th**3) and got[2][1:] == ("nan", False)


def test_intensity_of_flat_and_broken_clouds(spark, rows):
    pts = spark.createDataFrame([("a", 0, 1.0, 0.0, 0.0, 5.0), ("a", 1, 2.0, 0.0, 0.0, NAN), ("a", 2, NAN, 0.0, 0.0, 9.0), ("b", 0, 1.0, 1.0, 1.0, 7.0)], "c string, i int, x double, y double, z double, intensity double")
    assert rows(sp.normalise_intensity(pts, ["c"]), "c", "i", "intensity_u8") == [("a", 0, 255), ("a", 1, 0), ("b", 0, 128)]


def test_mismatched_paths_fail(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [3])], "f int, points array<double>, path_lengths array<int>")
    with pytest.raises(Exception, match="path_lengths"):
        sp.split_paths(df).collect()


def test_subsample_is_stable_and_small_spins_stay(spark, rows):
    pts = spark.createDataFrame([(1, i) for i in range(50)] + [(2, i) for i in range(3)], "ts_ns bigint, point_idx int")
    one, two = sp.subsample_points(pts, 10, 3, ["ts_ns"]), sp.subsample_points(pts.repartition(7), 10, 3, ["ts_ns"], target_rows=8)
    assert rows(one) == rows(two) and one.count() == 13
    assert rows(sp.subsample_points(pts, 10, 4, ["ts_ns"])) != rows(one)


# -- scalar functions ------------------------------------------------------------
def test_time_text(spark, rows):
    df = spark.createDataFrame([(0,), (-5,), (61_001_000_000,), (3_600_000_000_000,), (360_000_000_000_000,)], "ns bigint")
    assert rows(df.select("ns", tm.fmt_duration(F.col("ns")).alias("t"))) == [(-5, "00:00.000"), (0, "00:00.000"), (61_001_000_000, "01:01.001"), (3_600_000_000_000, "01:00:00.000"), (360_000_000_000_000, "100:00:00.000")]


def test_iso_times(spark):
    cases = {"2024-01-01T00:00:01.5Z": 1_704_067_201_500_000_000, "2024-01-01": 1_704_067_200_000_000_000, "2024-01-01 01:02": 1_704_070_920_000_000_000, "nope": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tm.iso_ns(F.col("t")).alias("ns"))
    assert {r.t: r.ns for r in df.collect()} == cases
