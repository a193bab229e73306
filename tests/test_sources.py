"""Readers and writers on files the tests write themselves."""

from __future__ import annotations

import json
import math
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chronofleet.operators.series import series_stats
from chronofleet.sources import annotations as an
from chronofleet.sources import mcap, recipe, roads, routing, sinks, tabular, video
from chronofleet.sources.pointcloud import read_spins, write_spins
from chronofleet.streaming.replay import append_to_lake, stream_samples

T0 = 1_704_067_200_000_000
# A winch log: force, state byte, tick in ms, drum angle.
WINCH = {
    "recipeVersion": 1,
    "container": {"type": "fixed_record", "headerSkipBytes": 12, "recordSizeBytes": 21},
    "time": {"field": "tick", "unit": "millis"},
    "fields": [
        {"name": "force", "offset": 0, "dtype": "i16", "endian": "be", "scale": 0.25, "valueOffset": -3.0},
        {"name": "state", "offset": 2, "dtype": "u8"},
        {"name": "tick", "offset": 3, "dtype": "u64", "endian": "be"},
        {"name": "drum", "offset": 11, "dtype": "f64"},
        {"name": "load", "offset": 19, "dtype": "u16"},
    ],
    "channels": [{"nativeId": "winch/force", "fields": ["force"]}, {"nativeId": "winch/drum", "fields": ["drum"]}, {"nativeId": "winch/state", "fields": ["state"]}],
}
M0 = T0 // 1000


# -- tabular ---------------------------------------------------------------------
def test_csv_log(spark, rows, tmp_path):
    (tmp_path / "a.csv").write_text('t_us,speed,note,ragged\n1000, 1.5 ,x,1\n2000,,y\n3000,2,"z,z",3\n')
    wide, classes = tabular.read_csv_log(spark, str(tmp_path / "a.csv"))
    assert rows(classes, "name", "kind") == [("note", "non_numeric"), ("ragged", "integer"), ("speed", "float"), ("t_us", "integer")]
    info = rows(tabular.inspect_log(wide.drop("source_file", "seq")).filter("is_time"), "name", "unit")
    assert info == [("t_us", "us")]
    long = tabular.unpivot_channels(wide, tabular.TimeBasis("t_us"), ["source_file", "seq"])
    assert rows(long, "channel_id", "ts_ns", "value") == [
        ("ragged", 1_000_000, 1.0), ("ragged", 2_000_000, "nan"), ("ragged", 3_000_000, 3.0), ("speed", 1_000_000, 1.5), ("speed", 2_000_000, "nan"), ("speed", 3_000_000, 2.0),
    ]


def test_csv_files_keep_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t_us,speed,rpm\n1,1.5,7\n2,2.5,8\n")
    (tmp_path / "b.csv").write_text("t_us,rpm,speed,brake\n1,10,bad,1\n2,20,3,0\n")
    wide, classes = tabular.read_csv_log(spark, str(tmp_path))
    name = F.element_at(F.split("source_file", "/"), -1)
    got = sorted((r.f, r.t_us, r.speed, r.rpm, r.brake) for r in wide.withColumn("f", name).collect())
    assert got == [("a.csv", 1, 1.5, 7, None), ("a.csv", 2, 2.5, 8, None), ("b.csv", 1, None, 10, 1), ("b.csv", 2, None, 20, 0)]
    kinds = {(r.f, r.name): r.kind for r in classes.withColumn("f", name).collect()}
    assert kinds["a.csv", "speed"] == "float" and kinds["b.csv", "speed"] == "non_numeric" and ("a.csv", "brake") not in kinds


def test_parquet_files_keep_their_own_columns(spark, rows, tmp_path):
    pq.write_table(pa.table({"t_us": [1, 2], "speed": [1.0, 2.0]}), tmp_path / "a.parquet")
    pq.write_table(pa.table({"t_us": [3], "speed": [7], "brake": [0.5]}), tmp_path / "b.parquet")
    df = tabular.read_parquet_log(spark, str(tmp_path), tabular.TimeBasis("t_us"))
    assert rows(df, "channel_id", "ts_ns", "value") == [("brake", 3000, 0.5), ("speed", 1000, 1.0), ("speed", 2000, 2.0), ("speed", 3000, 7.0)]


def test_parquet_files_given_are_all_read(spark, rows, tmp_path):
    names = ["a.parquet", "LOG.PARQUET", "b.log", "c"]
    for i, name in enumerate(names):
        pq.write_table(pa.table({"t_us": [i], "speed": [float(i)]}), tmp_path / name)
    df = tabular.read_parquet_log(spark, [str(tmp_path / n) for n in names], tabular.TimeBasis("t_us"))
    assert rows(df, "ts_ns") == [(0,), (1000,), (2000,), (3000,)]
    assert rows(tabular.read_parquet_log(spark, str(tmp_path), tabular.TimeBasis("t_us")), "ts_ns") == [(0,), (1000,)]
    (tmp_path / "d.txt").write_text("no footer")
    with pytest.raises(Exception, match="(?i)parquet"):
        tabular.read_parquet_log(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "d.txt")], tabular.TimeBasis("t_us"))


def test_csv_order_survives_many_splits(spark, tmp_path):
    (tmp_path / "big.csv").write_text("t,v\n" + "".join(f"{i},{i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        wide, _ = tabular.read_csv_log(spark, str(tmp_path / "big.csv"))
        assert wide.rdd.getNumPartitions() > 3
        assert [r.v for r in wide.orderBy("seq").select("v").collect()] == list(range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_parquet_log_reads_numeric_columns_only(spark, rows, tmp_path):
    t = pa.table({"t_us": pa.array([T0 + i for i in range(3)], pa.int64()), "speed": [0.0, 1.5, None], "ok": [True, False, None], "name": ["a", "b", "c"], "u": pa.array([1, 2, 3], pa.uint64())})
    pq.write_table(t, tmp_path / "s.parquet")
    df = tabular.read_parquet_log(spark, str(tmp_path / "s.parquet"), tabular.TimeBasis("t_us"))
    got = rows(df.filter("channel_id != 'u'"), "channel_id", "ts_ns", "value")
    base = T0 * 1000
    assert got == [("ok", base, 1.0), ("ok", base + 1000, 0.0), ("ok", base + 2000, "nan"), ("speed", base, 0.0), ("speed", base + 1000, 1.5), ("speed", base + 2000, "nan")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "name:string" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_missing_time_column_value(spark, rows):
    df = spark.createDataFrame([("s", 0, None, 1.0), ("s", 1, 5, 2.0)], "source_id string, seq bigint, t bigint, v double")
    drop, zero = tabular.TimeBasis("t", "s"), tabular.TimeBasis("t", "s", 7, "zero")
    assert rows(tabular.unpivot_channels(df, drop), "ts_ns") == [(5_000_000_000,)]
    assert rows(tabular.unpivot_channels(df, zero), "ts_ns") == [(7,), (5_000_000_007,)]


# -- binary records --------------------------------------------------------------
def _winch_record(i):
    return struct.pack(">hBQ", 40 - i % 50, i % 3, M0 + 20 * i) + struct.pack("<dH", i / 8, i % 65536)


def test_recipe_splits_and_ignores_the_partial_record(spark, rows, tmp_path):
    (tmp_path / "a.wlg").write_bytes(b"winch log 1." + b"".join(map(_winch_record, range(1000))) + b"cut")
    (tmp_path / "b.wlg").write_bytes(b"short")
    (tmp_path / "c.wlg").write_bytes(b"winch log 1." + _winch_record(5))
    df = recipe.read_recipe(spark, str(tmp_path), WINCH, split_bytes=21 * 64)
    splits = recipe.recipe_splits(routing.list_files(spark, str(tmp_path)), recipe.Recipe.parse(WINCH), 21 * 64)
    assert rows(splits, F.element_at(F.split("path", "/"), -1), "first_record", "records") == sorted([("a.wlg", at, min(64, 1000 - at)) for at in range(0, 1000, 64)] + [("c.wlg", 0, 1)])
    mine = df.filter(F.col("source_id").endswith("a.wlg"))
    assert rows(mine.filter("seq = 77"), "channel_id", "ts_ns", "value") == [("winch/drum", (M0 + 1540) * 10**6, 9.625), ("winch/force", (M0 + 1540) * 10**6, 0.25), ("winch/state", (M0 + 1540) * 10**6, 2.0)]
    assert rows(df.groupBy("channel_id").count()) == [("winch/drum", 1001), ("winch/force", 1001), ("winch/state", 1001)]
    files = mine.select("source_id").distinct().withColumn("n_bytes", F.lit(12 + 21000 + 3).cast("bigint"))
    times = recipe.profile_times(mine.filter("channel_id = 'winch/force'"), files, 12, 21)
    assert rows(times, "records", "violations", "median_delta_ns") == [(1000, 0, 20_000_000)]
    gate = recipe.gate_profile(times, recipe.profile_channels(mine))
    assert rows(gate, "accepted") == [(True,)]


def test_recipe_saturates_and_reads_float_time():
    r = recipe.Recipe.parse({**WINCH, "time": {"field": "tick", "unit": "seconds", "epochOffsetNs": "-5"}})
    ts, _ = r.decode(bytes(3) + struct.pack(">Q", 2**62) + bytes(10) + bytes(3) + struct.pack(">Q", 3) + bytes(10))
    assert ts.tolist() == [2**63 - 1 - 5, 3_000_000_000 - 5]
    f = recipe.Recipe.parse({**WINCH, "time": {"field": "drum", "unit": "nanos"}})
    ts, _ = f.decode(bytes(11) + struct.pack("<d", 2.5) + bytes(2) + bytes(11) + struct.pack("<d", math.nan) + bytes(2))
    assert ts.tolist() == [3, 0]


@pytest.mark.parametrize("change", [{"recipeVersion": 2}, {"time": {"field": "zz", "unit": "millis"}}, {"fields": [{"name": "tick", "offset": 20, "dtype": "u64"}]}, {"container": {"type": "fixed_record", "recordSizeBytes": 0}}, {"channels": [{"nativeId": "x", "fields": ["nope"]}]}])
def test_broken_recipes(change):
    with pytest.raises(ValueError):
        recipe.Recipe.parse({**WINCH, **change})


# -- containers ------------------------------------------------------------------
def _mcap_bytes(codec, n_chunks=4, per=5):
    def rec(op, body):
        return struct.pack("<BQ", op, len(body)) + body

    def text(s):
        return struct.pack("<I", len(s)) + s.encode()

    schema = rec(3, struct.pack("<H", 1) + text("foxglove.Float64") + text("jsonschema") + struct.pack("<I", 2) + b"{}")
    chans = b"".join(rec(4, struct.pack("<HH", i, 1) + text(f"/c{i}") + text("json") + struct.pack("<I", 0)) for i in (1, 2))
    out, index = mcap.MAGIC + rec(1, text("") + text("")), b""
    for k in range(n_chunks):
        cid = 1 if k % 2 == 0 else 2
        stamps = [k * 1000 + j for j in range(per)]
        raw = schema + chans + b"".join(rec(5, struct.pack("<HIQQ", cid, j, t, t) + b'{"value":%d}' % t) for j, t in enumerate(stamps))
        packed = pa.Codec("zstd").compress(raw, asbytes=True) if codec else raw
        body = struct.pack("<QQQI", stamps[0], stamps[-1], len(raw), 0) + text(codec) + struct.pack("<Q", len(packed)) + packed
        chunk = rec(6, body)
        index += rec(8, struct.pack("<QQQQI", stamps[0], stamps[-1], len(out), len(chunk), 10) + struct.pack("<HQ", cid, 0) + struct.pack("<Q", 0) + text(codec) + struct.pack("<QQ", len(packed), len(raw)))
        out += chunk
    out += rec(15, struct.pack("<I", 0))
    start = len(out)
    out += schema + chans + index
    return out + rec(2, struct.pack("<QQI", start, 0, 0)) + mcap.MAGIC


@pytest.mark.parametrize("codec", ["", "zstd"])
def test_mcap_prunes_chunks(spark, rows, tmp_path, codec):
    (tmp_path / "a.mcap").write_bytes(_mcap_bytes(codec))
    index = mcap.chunk_index(routing.list_files(spark, str(tmp_path)))
    assert rows(index, "ordinal", "first_time", "last_time", "topics", "chunked") == [(k, k * 1000, k * 1000 + 4, [f"/c{k % 2 + 1}"], True) for k in range(4)]
    df = mcap.read_mcap(spark, [str(tmp_path / "a.mcap")])
    assert df.count() == 20 == df.select("seq").distinct().count()
    part = mcap.read_mcap(spark, str(tmp_path), 1000, 3003, ["/c2"])
    assert rows(part.select("log_time", F.col("payload").cast("string"))) == [(t, f'{{"value":{t}}}') for t in [*range(1000, 1005), *range(3000, 3003)]]
    assert rows(df.select("schema_name", "encoding").distinct()) == [("foxglove.Float64", "jsonschema")]
    units = mcap._units(index.filter("first_time >= 2000"), mcap.PACK_BYTES).collect()
    assert len(units) == 1 and [p["first"] for p in units[0]["pieces"]] == [2 << 32, 3 << 32]  # read together, pruned before


def _plain_mcap(n, body):
    """A file of messages without chunks and without a summary; names come between the messages."""
    def rec(op, data):
        return struct.pack("<BQ", op, len(data)) + data

    def text(s):
        return struct.pack("<I", len(s)) + s.encode()

    out = [mcap.MAGIC, rec(1, text("") + text("")), rec(3, struct.pack("<H", 1) + text("S") + text("json") + struct.pack("<I", 0))]
    for i in range(n):
        if i in (0, n // 2):
            cid = 1 + (i > 0)
            out.append(rec(4, struct.pack("<HH", cid, 1) + text(f"/c{cid}") + text("json") + struct.pack("<I", 0)))
        out.append(rec(5, struct.pack("<HIQQ", 1 if i < n // 2 else 2, i, i, i) + body(i)))
    return b"".join(out) + rec(15, struct.pack("<I", 0)) + rec(2, struct.pack("<QQI", 0, 0, 0)) + mcap.MAGIC


@pytest.mark.parametrize("pack", [97, 1024, 1 << 20])
def test_mcap_without_an_index_is_read_in_ranges(spark, rows, tmp_path, pack):
    nested = _plain_mcap(20, lambda i: b"inner %d" % i)  # a payload that looks like records itself
    body = lambda i: b"%d " % i + (nested if i % 40 == 3 else b"\x05" * (i % 90) + bytes(i % 7))
    (tmp_path / "p.mcap").write_bytes(_plain_mcap(300, body))
    df = mcap.read_mcap(spark, str(tmp_path), pack_bytes=pack)
    assert rows(df, "seq", "log_time", "topic", "payload") == [(i, i, "/c1" if i < 150 else "/c2", bytearray(body(i))) for i in range(300)]
    whole = (tmp_path / "p.mcap").read_bytes()
    (tmp_path / "p.mcap").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="cut or damaged"):
        mcap.read_mcap(spark, str(tmp_path), pack_bytes=pack).collect()


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x.mcap").write_bytes(b"no" * 50)
    with pytest.raises(Exception, match="not an MCAP"):
        mcap.read_mcap(spark, [str(tmp_path / "x.mcap")]).collect()


# -- point clouds ----------------------------------------------------------------
def test_spins_with_ns_timestamps(spark, rows, tmp_path):
    table = pa.table({"t_ns": pa.array([5, 6], pa.timestamp("ns")), "positions": pa.array([[1.0, 2.0, 3.0], [1.0]], pa.list_(pa.float32())), "intensities": pa.array([[7], [1]], pa.list_(pa.uint8()))})
    pq.write_table(table, tmp_path / "a.lidar.parquet")
    good, bad = read_spins(spark, str(tmp_path / "a.lidar.parquet"))
    assert rows(good, "ts_ns", "positions", "intensities") == [(5, [1.0, 2.0, 3.0], [7])]
    assert rows(bad, "row_idx", "error") == [(1, "1 position floats for 1 intensities")]


def test_spin_sink_round_trip(spark, rows, tmp_path):
    pts = spark.createDataFrame([(9, i, float(i), 0.0, -1.0, i / 255) for i in range(4)], "ts_ns bigint, point_idx int, x float, y float, z float, intensity float")
    write_spins(pts, str(tmp_path / "out"), ["ts_ns"])
    good, bad = read_spins(spark, str(tmp_path / "out"))
    assert bad.isEmpty() and rows(good, "ts_ns", "intensities") == [(9, [0, 1, 2, 3])]


# -- documents and roads ---------------------------------------------------------
def test_openlabel_static_form(spark, rows, tmp_path):
    doc = {"openlabel": {"metadata": {"name": "cars"}, "objects": {"7": {"type": "Car", "object_data": {"cuboid": [{"val": [1, 2, 3, 0, 0, math.pi / 2, 4, 5, 6]}, {"traslation": [1, 2, 3], "size": [1, 1, 1], "quaternion": [1, 0, 0, 0]}, {"val": [1, 2]}]}}}}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text("{}")
    boxes, bad = an.read_openlabel(spark, str(tmp_path / "*.json"))
    got = rows(boxes, "channel_id", "ts_ns", "box_idx", "label", "qw", "sx")
    assert [(c, t, i, l, round(q, 4), s) for c, t, i, l, q, s in got] == [("cars", 0, 0, "Car", 0.7071, 4.0), ("cars", 0, 1, "Car", 1.0, 1.0)]
    assert bad.count() == 1


def test_empty_frames_are_kept(spark, rows):
    labels = {"openlabel": {"metadata": {"name": "cars"}, "frames": {"0": {"objects": {"7": {"object_data": {}}}}, "3": {"frame_properties": {"timestamp": "5.5"}}}}}
    path = {"trajectory": {"name": "p", "frames": [{"timestamp": "1", "paths": []}, {"timestamp": "2"}]}}
    docs = lambda d: spark.createDataFrame([("s", json.dumps(d)), ("t", "{}")], "source_id string, doc string")
    assert [(r.frame_no, r.n_objects) for r in an.openlabel_frames(docs(labels)).orderBy("frame_no").collect()] == [(0, 1), (3, 0)]
    assert rows(an.trajectory_frames(docs(path)), "source_id", "channel_id", "frame_no", "n_paths") == [("s", "p", 0, 0), ("s", "p", 1, 0)]


XODR = """<OpenDRIVE><road name="r" length="40" id="1"><planView>
<geometry s="0" x="0" y="0" hdg="0.3" length="10.4"><spiral curvStart="0.0" curvEnd="0.08"/></geometry>
<geometry s="10.4" x="10" y="3" hdg="0.7" length="4"><paramPoly3 aU="0" bU="1" cU="0.1" dU="0" aV="0" bV="0.2" cV="0" dV="0.01" pRange="arcLength"/></geometry>
</planView><lanes><laneSection s="0"><right><lane id="-1"><width a="3"/></lane></right></laneSection></lanes></road>
<road id="2"><planView/></road></OpenDRIVE>"""


def test_opendrive_spiral_and_parametric_cubic(spark, tmp_path):
    (tmp_path / "m.xodr").write_text(XODR)
    df = roads.read_opendrive(spark, str(tmp_path / "m.xodr"))
    pts = [(r.x, r.y) for r in df.filter("feature = 'centerline'").orderBy("point_idx").collect()]
    # Brute force of the half-metre trapezoid rule and the cubic.
    n = math.ceil(10.4 / 0.5)
    ds = 10.4 / n
    head = lambda s: 0.3 + 0.5 * 0.08 / 10.4 * s * s
    xs = np.concatenate([[0], np.cumsum([ds / 2 * (math.cos(head(i * ds)) + math.cos(head((i + 1) * ds))) for i in range(n)])])
    ys = np.concatenate([[0], np.cumsum([ds / 2 * (math.sin(head(i * ds)) + math.sin(head((i + 1) * ds))) for i in range(n)])])
    at = [10.4 * i / 11 for i in range(12)]
    want = list(zip(np.interp(at, np.arange(n + 1) * ds, xs), np.interp(at, np.arange(n + 1) * ds, ys)))
    for i in range(1, 5):
        u, v = i + 0.1 * i * i, 0.2 * i + 0.01 * i**3
        want.append((10 + math.cos(0.7) * u - math.sin(0.7) * v, 3 + math.sin(0.7) * u + math.cos(0.7) * v))
    assert np.allclose(pts, want, atol=1e-4)
    assert df.filter("type = 'road_edge'").count() == len(pts)
    assert df.select("road_id").distinct().count() == 1


# -- video and routing -----------------------------------------------------------
def test_sidecar_files(spark, rows, tmp_path):
    (tmp_path / "a.mp4.timestamps").write_text("0\t100\n 1\t 200 \n2\t300\n")
    (tmp_path / "b.mp4.timestamps").write_text("0\t100\n2\t200\n")
    good, bad = video.read_sidecar(spark, str(tmp_path / "*.timestamps"))
    assert rows(good, "frame", "ts_ns") == [(0, 100), (1, 200), (2, 300)]
    assert rows(bad, "error") == [("line 1: frame is not the line number",)]


def test_routing_of_real_files(spark, rows, tmp_path):
    for name, text in {"a.mp4": "x", "a.mp4.timestamps": "x", "b.mp4": "x", "c.mp4.timestamps": "x", "x.json": '{"trajectory" : 1}', "y.lidar.parquet": "x"}.items():
        (tmp_path / name).write_text(text)
    files = routing.read_heads(routing.list_files(spark, str(tmp_path)))
    got = rows(routing.classify_files(files, "m/v1"), "name", "kind", "error")
    assert got == [
        ("a.mp4", "video", None), ("a.mp4.timestamps", "sidecar", None), ("b.mp4", "video_untimed", None), ("c.mp4.timestamps", "sidecar", "sidecar of a video that is not here: c.mp4"),
        ("x.json", "trajectory", None), ("y.lidar.parquet", "lidar", None),
    ]


def test_recipes_match_heads_of_listed_files(spark, rows, tmp_path):
    (tmp_path / "x.unknown").write_bytes(b"....ACME")
    (tmp_path / "y.unknown").write_bytes(b"..")
    recipes = spark.createDataFrame([("v1", 0, [".acme"], [(4, "41 43 4d 45")])], "recipe_id string, ord int, extensions array<string>, magics array<struct<offset:int,hex:string>>")
    files = routing.list_files(spark, str(tmp_path))
    got = rows(recipe.match_recipes(routing.read_heads(files, recipes=recipes), recipes), "recipe_id", "matched_by")
    assert got == [("v1", "magic"), (None, None)]
    with pytest.raises(Exception, match="shorter than the 8 bytes"):
        recipe.match_recipes(routing.read_heads(files), recipes).collect()


# -- sinks -----------------------------------------------------------------------
def _samples(spark, n=1000):
    return spark.range(n).select(
        F.concat(F.lit("log-"), (F.col("id") % 3).cast("string")).alias("source_id"), F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("channel_id"),
        (F.col("id") * 7919 % n * 1000).alias("ts_ns"), F.col("id").alias("seq"), F.col("id").cast("double").alias("value"),
    )


def test_csv_quotes_and_empty_cells(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b,c', None), (2, "", 2.5)], "ts_ns bigint, name string, v double").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == 'ts_ns,name,v\n1,"a""b,c",\n2,,2.5\n'


def test_lake_scan_is_pruned_and_sorted(spark, tmp_path):
    sinks.write_samples(_samples(spark), str(tmp_path / "lake"), 4)
    lake = sinks.read_samples(spark, str(tmp_path / "lake"))
    assert lake.count() == 1000
    part = lake.filter((F.col("source_id") == "log-1") & (F.col("channel_id") == "c2") & (F.col("ts_ns") >= 5000))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_id" in plan and "GreaterThanOrEqual(ts_ns,5000)" in plan


def test_sidecar_sink_reads_back(spark, rows, tmp_path):
    f = spark.createDataFrame([("v", 5, 100), ("v", 9, 50)], "channel_id string, decode_idx bigint, ts_ns bigint")
    sinks.write_sidecar(f, str(tmp_path / "side"), ["channel_id"])
    assert sorted(p.read_text() for p in (tmp_path / "side" / "channel_id=v").glob("part-*")) == ["0\t100\n1\t50\n"]
    good, bad = video.read_sidecar(spark, str(tmp_path / "side" / "channel_id=v"))
    assert bad.isEmpty() and rows(good, "ts_ns") == [(50,), (100,)]


def test_arrow_sink(spark):
    table = _samples(spark, 10).toArrow()
    assert table.num_rows == 10 and table.schema.field("ts_ns").type == pa.int64()


def test_stream_replay_fills_the_lake(spark, rows, tmp_path):
    src = _samples(spark, 100)
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = stream_samples(spark, str(tmp_path / "in"), src.schema).filter("ts_ns < 50000").withColumn("value", F.abs("value"))
    append_to_lake(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert rows(series_stats(spark.read.parquet(str(tmp_path / "out")))) == rows(series_stats(src.filter("ts_ns < 50000")))


def test_group_time_sums_pass_a_bigint(spark, rows, tmp_path):
    from chronofleet.registry.ingest import s29

    lines = [(k, 1, 1, t) for k, t in ((1, 7e9), (2, 7e9), (3, 5e9), (6, 9e9))]
    spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1,)], "s_suppkey bigint").write.parquet(str(tmp_path / "supplier.parquet"))
    start = T0 * 1000
    assert rows(s29(spark, str(tmp_path)), "group_id", "n", "first_ns", "last_ns", "sum_rel") == [(1, 4, start, start + 7 * 10**18, 19 * 10**18)]


def test_composition_times_broadcast_no_samples(spark):
    i = F.col("id")  # a range has a known, small size
    runs = spark.range(2).select(F.lit("v").alias("channel_id"), i.alias("run_idx"), (3 - i).alias("sample_count"), (2 + 3 * i).alias("delta"), (1 - i).alias("offset"))
    out = video.composition_times(runs.drop("offset"), runs.drop("delta"), ["channel_id"])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.decode_idx, r.composition) for r in out.collect()) == [(0, 1), (1, 3), (2, 5), (3, 6), (4, 11)]
