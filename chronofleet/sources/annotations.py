"""Annotation documents: cuboids, trajectories, calibrations and maps.

Each ``parse_*`` takes a frame with one JSON document per row in ``doc`` plus any
identifying columns, so a reader over files and a table of documents share it. A
document is one row; rows spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofleet.functions.geometry import euler_to_quat
from chronofleet.functions.time import frame_ts_ns

# Map feature types that are kept by name.
FEATURE_TYPES = ("lane_boundary", "road_edge", "centerline", "crosswalk", "stop_line", "driving")

NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"

_NUMS = "ARRAY<STRING>"
_CUBOIDS = (
    f"STRUCT<cuboid: ARRAY<STRUCT<val: {_NUMS}, translation: {_NUMS}, traslation: {_NUMS}, size: {_NUMS},"
    f" quaternion: {_NUMS}, euler: {_NUMS}, rotation: {_NUMS}>>>"
)
_OPENLABEL = (
    "openlabel STRUCT<metadata: STRUCT<name: STRING>,"
    f" objects: MAP<STRING, STRUCT<type: STRING, name: STRING, object_data: {_CUBOIDS}>>,"
    " frames: MAP<STRING, STRUCT<frame_properties: STRUCT<timestamp: VARIANT>,"
    f" objects: MAP<STRING, STRUCT<object_data: {_CUBOIDS}>>>>>"
)


def read_documents(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """One row per file: ``source_id`` (its path) and ``doc``."""
    raw = spark.read.option("wholetext", True).text(paths)
    return raw.select(F.col("_metadata.file_path").alias("source_id"), F.col("value").alias("doc"))


def numbers(c: Column) -> Column:
    """The numeric entries of a JSON array as doubles; other entries are left out."""
    return F.transform(F.filter(c, lambda s: s.isNotNull() & s.rlike(NUMBER)), lambda s: s.try_cast("double"))


def _is_number(variant: Column) -> Column:
    return F.coalesce(F.schema_of_variant(variant).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.lit(False))


def _text(variant: Column) -> Column:
    return F.try_variant_get(variant, "$", "string")


def point3(text: Column) -> Column:
    """The JSON text ``[x, y]`` or ``[x, y, z]`` as a float struct, else NULL."""
    n = numbers(F.from_json(text, "array<string>"))
    x, y, z = (F.get(n, F.lit(i)).cast("float") for i in range(3))
    whole = F.struct(x.alias("x"), y.alias("y"), F.coalesce(z, F.lit(0.0).cast("float")).alias("z"))
    return F.when(F.size(n).isin(2, 3), whole)


def points3(c: Column) -> Column:
    return F.filter(F.transform(c, point3), lambda p: p.isNotNull())


# -- cuboids ---------------------------------------------------------------------
def parse_openlabel(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``boxes`` and the rejected documents.

    Boxes keep the identifying columns and add ``channel_id, ts_ns, frame_no, uid,
    box_idx, cx..cz, sx..sz, qx..qw, label``; quaternions are scalar-last.
    """
    ids = [c for c in docs.columns if c != "doc"]
    parsed = docs.select(*ids, F.from_json("doc", _OPENLABEL).alias("j"))
    rejected = parsed.filter(F.col("j.openlabel").isNull()).select(*ids, F.lit("no openlabel document").alias("error"))
    ol = parsed.select(*ids, "j.openlabel.*").filter(F.col("metadata").isNotNull() | F.col("objects").isNotNull() | F.col("frames").isNotNull())
    base = ol.withColumn("channel_id", F.coalesce("metadata.name", F.lit("objects")))
    seq = base.filter(F.col("frames").isNotNull()).select(*ids, "channel_id", "objects", F.explode("frames").alias("_no", "_f"))
    frame_no = F.coalesce(F.col("_no").try_cast("bigint"), F.lit(9223372036854775807))
    stamp = F.col("_f.frame_properties.timestamp")
    seq = seq.select(
        *ids, "channel_id", "objects", frame_no.alias("frame_no"),
        frame_ts_ns(_text(stamp), _is_number(stamp), frame_no).alias("ts_ns"),
        F.explode("_f.objects").alias("uid", "_o"),
    )
    static = base.filter(F.col("frames").isNull()).select(
        *ids, "channel_id", "objects", F.lit(0).cast("bigint").alias("frame_no"), F.lit(0).cast("bigint").alias("ts_ns"),
        F.explode(F.transform_values("objects", lambda k, v: F.struct(v["object_data"].alias("object_data")))).alias("uid", "_o"),
    )
    rows = seq.unionByName(static)
    known = F.try_element_at("objects", F.col("uid"))
    label = F.coalesce(known["type"], known["name"], F.lit("object"))
    rows = rows.select(*ids, "channel_id", "frame_no", "ts_ns", "uid", label.alias("label"), F.posexplode("_o.object_data.cuboid").alias("box_idx", "c"))
    rows = rows.withColumn("g", _cuboid(F.col("c"))).filter(F.col("g").isNotNull())
    return rows.select(*ids, "channel_id", "frame_no", "ts_ns", "uid", "box_idx", "g.*", "label"), rejected


def openlabel_frames(docs: DataFrame) -> DataFrame:
    """``channel_id, frame_no, ts_ns, n_objects`` of every frame, those without boxes too.

    A document without frames is one frame at time 0.
    """
    ids = [c for c in docs.columns if c != "doc"]
    ol = docs.select(*ids, F.from_json("doc", _OPENLABEL)["openlabel"].alias("o")).filter(F.col("o").isNotNull()).select(*ids, "o.*")
    base = ol.filter(F.col("metadata").isNotNull() | F.col("objects").isNotNull() | F.col("frames").isNotNull())
    base = base.withColumn("channel_id", F.coalesce("metadata.name", F.lit("objects")))
    seq = base.filter(F.col("frames").isNotNull()).select(*ids, "channel_id", F.explode("frames").alias("_no", "_f"))
    frame_no = F.coalesce(F.col("_no").try_cast("bigint"), F.lit(9223372036854775807))
    stamp = F.col("_f.frame_properties.timestamp")
    many = lambda c: F.when(c.isNull(), 0).otherwise(F.size(c)).alias("n_objects")
    seq = seq.select(*ids, "channel_id", frame_no.alias("frame_no"), frame_ts_ns(_text(stamp), _is_number(stamp), frame_no).alias("ts_ns"), many(F.col("_f.objects")))
    zero = F.lit(0).cast("bigint")
    static = base.filter(F.col("frames").isNull()).select(*ids, "channel_id", zero.alias("frame_no"), zero.alias("ts_ns"), many(F.col("objects")))
    return seq.unionByName(static)


def _geometry(at: Column, centre: tuple[int, ...], size: Column, size_at: tuple[int, ...], quat: tuple[Column, ...]) -> Column:
    parts = [F.get(at, F.lit(i)).cast("float").alias(n) for i, n in zip(centre, ("cx", "cy", "cz"))]
    parts += [F.get(size, F.lit(i)).cast("float").alias(n) for i, n in zip(size_at, ("sx", "sy", "sz"))]
    parts += [q.cast("float").alias(n) for q, n in zip(quat, ("qx", "qy", "qz", "qw"))]
    return F.struct(*parts)


def _cuboid(c: Column) -> Column:
    val = numbers(c["val"])
    v = [F.get(val, F.lit(i)) for i in range(10)]
    with_quat = _geometry(val, (0, 1, 2), val, (7, 8, 9), (v[3], v[4], v[5], v[6]))
    with_euler = _geometry(val, (0, 1, 2), val, (6, 7, 8), euler_to_quat(v[3], v[4], v[5]))
    at, size = numbers(F.coalesce(c["translation"], c["traslation"])), numbers(c["size"])
    q, e = numbers(c["quaternion"]), numbers(F.coalesce(c["euler"], c["rotation"]))
    qs, es = [F.get(q, F.lit(i)) for i in (1, 2, 3, 0)], [F.get(e, F.lit(i)) for i in range(3)]
    ident = tuple(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0))
    plain = (0, 1, 2)
    turned = (
        F.when(q.isNotNull(), F.when(F.size(q) == 4, _geometry(at, plain, size, plain, tuple(qs))))
        .when(e.isNotNull(), F.when(F.size(e) == 3, _geometry(at, plain, size, plain, euler_to_quat(*es))))
        .otherwise(_geometry(at, plain, size, plain, ident))
    )
    loose = F.when((F.size(at) == 3) & (F.size(size) == 3), turned)
    return F.when(c["val"].isNull(), loose).when(F.size(val) == 10, with_quat).when(F.size(val) == 9, with_euler)


def read_openlabel(spark: SparkSession, paths: Sequence[str] | str) -> tuple[DataFrame, DataFrame]:
    return parse_openlabel(read_documents(spark, paths))


# -- trajectories ----------------------------------------------------------------
_TRAJECTORY = (
    "trajectory STRUCT<frame_id: STRING, name: STRING, frames: ARRAY<STRUCT<timestamp: VARIANT,"
    " paths: ARRAY<STRING>>>>"
)
# Paths and points are kept as JSON text first, so that a malformed one is skipped alone.
_PATH = "confidence DOUBLE, points ARRAY<STRING>"


def parse_trajectories(docs: DataFrame) -> DataFrame:
    """``channel_id, frame_no, ts_ns, path_idx, confidence, points`` per path.

    Malformed points and empty paths are skipped; ``path_idx`` counts the kept paths.
    """
    ids = [c for c in docs.columns if c != "doc"]
    tr = docs.select(*ids, F.from_json("doc", _TRAJECTORY)["trajectory"].alias("t")).filter(F.col("t").isNotNull())
    name = F.coalesce("t.frame_id", "t.name", F.lit("trajectory"))
    frames = tr.select(*ids, name.alias("channel_id"), F.posexplode("t.frames").alias("frame_no", "f"))
    stamp = F.col("f.timestamp")
    ts = frame_ts_ns(_text(stamp), _is_number(stamp), F.col("frame_no"), iso=False)
    parsed = F.transform("f.paths", lambda p: F.from_json(p, _PATH))
    cut = F.transform(
        parsed,
        lambda p: F.struct(F.coalesce(p["confidence"], F.lit(1.0)).cast("float").alias("confidence"), points3(p["points"]).alias("points")),
    )
    kept = F.filter(cut, lambda p: F.size(p["points"]) > 0)
    return frames.select(*ids, "channel_id", "frame_no", ts.alias("ts_ns"), F.posexplode(kept).alias("path_idx", "p")).select(
        *ids, "channel_id", "frame_no", "ts_ns", "path_idx", "p.*"
    )


def trajectory_frames(docs: DataFrame) -> DataFrame:
    """``channel_id, frame_no, ts_ns, n_paths`` of every frame, those without paths too."""
    ids = [c for c in docs.columns if c != "doc"]
    tr = docs.select(*ids, F.from_json("doc", _TRAJECTORY)["trajectory"].alias("t")).filter(F.col("t").isNotNull())
    name = F.coalesce("t.frame_id", "t.name", F.lit("trajectory"))
    frames = tr.select(*ids, name.alias("channel_id"), F.posexplode("t.frames").alias("frame_no", "f"))
    stamp = F.col("f.timestamp")
    ts = frame_ts_ns(_text(stamp), _is_number(stamp), F.col("frame_no"), iso=False)
    return frames.select(*ids, "channel_id", "frame_no", ts.alias("ts_ns"), F.when(F.col("f.paths").isNull(), 0).otherwise(F.size("f.paths")).alias("n_paths"))


def read_trajectories(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    return parse_trajectories(read_documents(spark, paths))


# -- calibrations ----------------------------------------------------------------
_CAMERAS = (
    "schema STRING, cameras ARRAY<STRUCT<name: STRING, model: STRING,"
    " intrinsics: STRUCT<fx: DOUBLE, fy: DOUBLE, cx: DOUBLE, cy: DOUBLE, width: DOUBLE, height: DOUBLE>,"
    f" distortion: {_NUMS}, forward_poly: {_NUMS}, extrinsic: STRUCT<translation: {_NUMS}, quaternion: {_NUMS}>>>"
)


def parse_cameras(docs: DataFrame, marker: str) -> tuple[DataFrame, DataFrame]:
    """Cameras of valid documents, and the documents with an error.

    ``marker`` is the value the ``schema`` field must have. One bad camera rejects its
    document; ``errors`` lists every broken rule.
    """
    ids = [c for c in docs.columns if c != "doc"]
    parsed = docs.select(*ids, F.from_json("doc", _CAMERAS).alias("j"))

    def floats(c: Column) -> Column:
        return F.transform(numbers(F.coalesce(c, F.array().cast("array<string>"))), lambda x: x.cast("float"))

    def rules(c: Column, i: Column) -> Column:
        k, e = c["intrinsics"], c["extrinsic"]
        model = F.coalesce(c["model"], F.lit("pinhole"))
        n_dist, n_poly = F.size(floats(c["distortion"])), F.size(floats(c["forward_poly"]))
        found = [
            (c["name"].isNull(), "it has no name"),
            (~model.isin("pinhole", "ftheta"), "its model is neither pinhole nor ftheta"),
            *[(k[f].isNull(), f"its intrinsics lack {f}") for f in ("fx", "fy", "cx", "cy", "width", "height")],
            (n_dist != F.coalesce(F.size(c["distortion"]), F.lit(0)), "not every distortion coefficient is a number"),
            (~n_dist.isin(0, 5), "distortion takes five coefficients or none"),
            (n_poly != F.coalesce(F.size(c["forward_poly"]), F.lit(0)), "not every coefficient of forward_poly is a number"),
            ((model == "ftheta") & (n_poly < 2), "an ftheta model takes two coefficients of forward_poly or more"),
            ((model == "pinhole") & (n_poly > 0), "a pinhole model takes no forward_poly"),
            (F.coalesce(F.size(numbers(e["translation"])), F.lit(0)) != 3, "translation is no vector of three"),
            (F.coalesce(F.size(numbers(e["quaternion"])), F.lit(0)) != 4, "quaternion is no vector of four"),
        ]
        broken = F.array(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(text)) for cond, text in found])
        return F.transform(F.array_compact(broken), lambda m: F.concat(F.lit("camera "), i.cast("string"), F.lit(": "), m))

    per_camera = F.flatten(F.transform("j.cameras", rules))
    header = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("j.schema") == marker, F.lit(False)), F.lit("schema is not the one asked for")),
            F.when(F.col("j.cameras").isNull(), F.lit("there is no list of cameras")),
        )
    )
    judged = parsed.withColumn("errors", F.concat(header, F.coalesce(per_camera, F.array().cast("array<string>"))))
    cams = judged.filter(F.size("errors") == 0).select(*ids, F.explode("j.cameras").alias("c"))
    k = F.col("c.intrinsics")
    valid = cams.select(
        *ids,
        F.col("c.name").alias("name"),
        F.coalesce("c.model", F.lit("pinhole")).alias("model"),
        F.array(*[k[f].cast("float") for f in ("fx", "fy", "cx", "cy")]).alias("intrinsics"),
        F.array(k["width"].cast("int"), k["height"].cast("int")).alias("resolution"),
        floats(F.col("c.distortion")).alias("distortion"),
        floats(F.col("c.forward_poly")).alias("forward_poly"),
        floats(F.col("c.extrinsic.translation")).alias("translation"),
        floats(F.col("c.extrinsic.quaternion")).alias("quaternion"),
    )
    return valid, judged.filter(F.size("errors") > 0).select(*ids, "errors")


def read_cameras(spark: SparkSession, paths: Sequence[str] | str, marker: str) -> tuple[DataFrame, DataFrame]:
    return parse_cameras(read_documents(spark, paths), marker)


# -- maps ------------------------------------------------------------------------
def parse_map_json(docs: DataFrame, root_key: str = "map") -> DataFrame:
    """``channel_id, feature_idx, type, points`` of features with two points or more.

    ``feature_idx`` counts the kept features; unknown types become ``other``.
    """
    ids = [c for c in docs.columns if c != "doc"]
    schema = f"`{root_key}` STRUCT<name: STRING, features: ARRAY<STRUCT<type: STRING, polyline: ARRAY<STRING>>>>"
    maps = docs.select(*ids, F.from_json("doc", schema)[root_key].alias("m")).filter(F.col("m").isNotNull())

    def feature(f: Column) -> Column:
        kind = F.trim(f["type"])
        named = F.when(kind.isin(*FEATURE_TYPES), kind).otherwise("other")
        return F.struct(named.alias("type"), points3(f["polyline"]).alias("points"))

    kept = F.filter(F.transform("m.features", feature), lambda f: F.size(f["points"]) >= 2)
    rows = maps.select(*ids, F.coalesce("m.name", F.lit("map")).alias("channel_id"), F.posexplode(kept).alias("feature_idx", "f"))
    return rows.select(*ids, "channel_id", "feature_idx", "f.*")


def read_map_json(spark: SparkSession, paths: Sequence[str] | str, root_key: str = "map") -> DataFrame:
    return parse_map_json(read_documents(spark, paths), root_key)
