"""OpenDRIVE road networks as dense polylines, one row per point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Sampling distances in metres.
SAMPLE_STEP = 1.0
SPIRAL_STEP = 0.5

_LANES = "STRUCT<lane: ARRAY<STRUCT<_id: STRING, width: ARRAY<STRUCT<_a: DOUBLE>>>>>"
ROAD_SCHEMA = (
    "_id STRING, planView STRUCT<geometry: ARRAY<STRUCT<_s: DOUBLE, _x: DOUBLE, _y: DOUBLE, _hdg: DOUBLE, _length: DOUBLE,"
    " arc: STRUCT<_curvature: DOUBLE>, spiral: STRUCT<_curvStart: DOUBLE, _curvEnd: DOUBLE>,"
    " poly3: STRUCT<_a: DOUBLE, _b: DOUBLE, _c: DOUBLE, _d: DOUBLE>,"
    " paramPoly3: STRUCT<_aU: DOUBLE, _bU: DOUBLE, _cU: DOUBLE, _dU: DOUBLE, _aV: DOUBLE, _bV: DOUBLE, _cV: DOUBLE, _dV: DOUBLE, _pRange: STRING>>>>,"
    " elevationProfile STRUCT<elevation: ARRAY<STRUCT<_s: DOUBLE, _a: DOUBLE, _b: DOUBLE, _c: DOUBLE, _d: DOUBLE>>>,"
    f" lanes STRUCT<laneSection: ARRAY<STRUCT<left: {_LANES}, right: {_LANES}>>>"
)


def read_opendrive(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Feature points of every road of the files."""
    raw = spark.read.format("xml").option("rowTag", "road").schema(ROAD_SCHEMA).load(paths)
    return densify_roads(raw.select(F.col("_metadata.file_path").alias("source_id"), F.col("_id").alias("road_id"), "planView", "elevationProfile", "lanes"))


def _zero(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c, F.lit(default))


def densify_roads(roads: DataFrame, ids: Sequence[str] = ("source_id", "road_id")) -> DataFrame:
    """``(ids, feature, type, point_idx, x, y, z)`` of centre lines and lane borders.

    A geometry gives a point about every metre, its first one only where it does not
    continue the geometry before. Borders run at the summed lane widths to the left of
    the heading (right lanes to the right); the outermost of a side is a road edge.
    Roads without usable geometry give nothing.
    """
    ids = list(ids)
    section = F.get("lanes.laneSection", F.lit(0))
    flat = roads.select(*ids, "planView", F.array_sort(_elevations()).alias("_elev"), _borders(section).alias("_borders"))
    flat = flat.select(*ids, "_elev", "_borders", F.posexplode("planView.geometry").alias("geom_idx", "g"))
    g = F.col("g")
    geoms = flat.select(
        *ids, "geom_idx", "_elev", "_borders", "g",
        *[_zero(g[f"_{a}"]).alias(f"_{a}0") for a in ("s", "x", "y", "hdg")], _zero(g["_length"]).alias("_len"),
    )
    geoms = geoms.filter((F.col("_len") > 0) & (F.col("_len") < float("inf")))
    w = Window.partitionBy(*ids).orderBy("geom_idx")
    joins = F.abs(F.lag(F.col("_s0") + F.col("_len")).over(w) - F.col("_s0")) < 1e-6
    geoms = geoms.withColumn("_from", F.when(joins, 1).otherwise(0)).withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("_len") / SAMPLE_STEP).cast("int")))
    clothoid = g["spiral"].isNotNull() & ~_bends(g)
    plain = geoms.filter(~clothoid).select("*", F.explode(F.sequence("_from", F.col("_n"))).alias("_i")).withColumn("_p", _pose(F.col("_i")))
    rows = plain.select(*geoms.columns, "_i", "_p").unionByName(_clothoids(geoms.filter(clothoid), ids))
    points = rows.select(*ids, "geom_idx", "_i", "_elev", "_borders", (F.col("_s0") + F.col("_len") * F.col("_i") / F.col("_n")).alias("_s"), "_p.*")
    points = points.withColumn("z", _height(F.col("_s")))
    centre = F.struct(F.lit("centerline").alias("feature"), F.lit("centerline").alias("type"), F.lit(0.0).alias("offset"))
    spread = points.select(*ids, "geom_idx", "_i", "x", "y", "z", "hdg", F.inline(F.concat(F.array(centre), "_borders")))
    off = F.col("offset")
    placed = spread.select(
        *ids, "feature", "type", "geom_idx", "_i",
        (F.col("x") - F.sin("hdg") * off).cast("float").alias("x"),
        (F.col("y") + F.cos("hdg") * off).cast("float").alias("y"),
        F.col("z").cast("float").alias("z"),
    )
    # A road is one polyline of about a point per metre.
    order = Window.partitionBy(*ids, "feature").orderBy("geom_idx", "_i")
    return placed.select(*ids, "feature", "type", (F.row_number().over(order) - 1).alias("point_idx"), "x", "y", "z")


def _elevations() -> Column:
    none = F.array().cast("array<struct<s:double,a:double,b:double,c:double,d:double>>")
    found = F.transform(
        "elevationProfile.elevation", lambda e: F.struct(*[_zero(e[f"_{n}"]).alias(n) for n in ("s", "a", "b", "c", "d")])
    )
    return F.coalesce(found, none)


def _height(s: Column) -> Column:
    reached = F.filter("_elev", lambda e: e["s"] <= s)
    e = F.when(F.size(reached) > 0, F.try_element_at(reached, F.lit(-1))).otherwise(F.get("_elev", F.lit(0)))
    d = s - e["s"]
    return F.coalesce(e["a"] + e["b"] * d + e["c"] * d * d + e["d"] * d * d * d, F.lit(0.0))


def _borders(section: Column) -> Column:
    sides = []
    for side, sign in (("left", 1.0), ("right", -1.0)):
        lanes = F.transform(
            section[side]["lane"],
            lambda lane, i: F.named_struct(
                F.lit("n"), F.abs(F.coalesce(F.trim(lane["_id"]).try_cast("bigint"), F.lit(0).cast("bigint"))),
                F.lit("i"), i,
                F.lit("w"), _zero(F.get(lane["width"], F.lit(0))["_a"]),
            ),
        )
        outward = F.array_sort(lanes)

        none = F.array().cast("array<struct<feature:string,type:string,offset:double>>")
        sides.append(F.coalesce(F.transform(outward, _border(outward, side, sign)), none))
    return F.concat(*sides)


def _border(outward: Column, side: str, sign: float):
    def border(lane: Column, k: Column) -> Column:
        upto = F.aggregate(F.slice(outward, F.lit(1), k + 1), F.lit(0.0), lambda acc, x: acc + x["w"])
        edge = F.when(k == F.size(outward) - 1, "road_edge").otherwise("lane_boundary")
        name = F.concat(F.lit(f"{side}_"), (k + 1).cast("string"))
        return F.named_struct(F.lit("feature"), name, F.lit("type"), edge, F.lit("offset"), upto * sign)

    return border


def _pose(i: Column) -> Column:
    """Planar pose at sample ``i`` of the geometry in the current row."""
    g = F.col("g")
    s = F.col("_len") * i / F.col("_n")
    x0, y0, h0 = F.col("_x0"), F.col("_y0"), F.col("_hdg0")

    def pose(x: Column, y: Column, h: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), h.alias("hdg"))

    line = pose(x0 + F.cos(h0) * s, y0 + F.sin(h0) * s, h0)
    k = _zero(g["arc"]["_curvature"])
    r = 1.0 / F.when(F.abs(k) >= 1e-12, k)
    theta = h0 + k * s
    arc = pose(x0 - r * F.sin(h0) + r * F.sin(theta), y0 + r * F.cos(h0) - r * F.cos(theta), theta)
    curved = (
        F.when(_bends(g), arc)
        .when(g["poly3"].isNotNull(), _bent(i, _poly3))
        .when(g["paramPoly3"].isNotNull(), _bent(i, _param_poly3))
    )
    return F.coalesce(curved, line)


def _bends(g: Column) -> Column:
    return F.coalesce(g["arc"].isNotNull() & (F.abs(_zero(g["arc"]["_curvature"])) >= 1e-12), F.lit(False))


def _clothoids(geoms: DataFrame, ids: list[str]) -> DataFrame:
    """Rows ``_i``, ``_p`` of spirals by trapezoids on a half-metre grid, linear between its nodes.

    One row per node holds the way to the next; a running sum gives the place of each node, and
    the samples that lie behind a node are placed from it.
    """
    length, h0, n = F.col("_len"), F.col("_hdg0"), F.col("_n")
    k0, k1 = _zero(F.col("g")["spiral"]["_curvStart"]), _zero(F.col("g")["spiral"]["_curvEnd"])

    def heading(at: Column) -> Column:
        return h0 + k0 * at + 0.5 * (k1 - k0) / length * at * at

    grid = geoms.withColumn("_steps", F.greatest(F.lit(1), F.ceil(length / SPIRAL_STEP).cast("int"))).withColumn("_ds", length / F.col("_steps"))
    nodes = grid.select("*", F.explode(F.sequence(F.lit(0), F.col("_steps") - 1)).alias("_j"))
    a, b = heading(F.col("_ds") * F.col("_j")), heading(F.col("_ds") * (F.col("_j") + 1))
    way = {f"_d{c}": F.col("_ds") * 0.5 * (fn(a) + fn(b)) for c, fn in (("x", F.cos), ("y", F.sin))}
    nodes = nodes.withColumns({**way, "_a": a, "_b": b})
    before = Window.partitionBy(*ids, "geom_idx").orderBy("_j").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumns({f"_at{c}": F.coalesce(F.sum(f"_d{c}").over(before), F.lit(0.0)) for c in "xy"})

    def node_of(i: Column) -> Column:
        return F.least(F.floor(length * i / n / F.col("_ds")).cast("int"), F.col("_steps") - 1)

    # A node has two samples at most, near the same share of the way.
    near = F.floor(F.col("_j") * n / F.col("_steps")).cast("int")
    behind = F.filter(F.sequence(near - 1, near + 2), lambda i: (i >= F.col("_from")) & (i <= n) & (node_of(i) == F.col("_j")))
    rows = nodes.select("*", F.explode(behind).alias("_i"))
    part = length * F.col("_i") / n / F.col("_ds") - F.col("_j")
    pose = F.struct(
        (F.col("_x0") + F.col("_atx") + F.col("_dx") * part).alias("x"), (F.col("_y0") + F.col("_aty") + F.col("_dy") * part).alias("y"),
        (F.col("_a") + (F.col("_b") - F.col("_a")) * part).alias("hdg"),
    )
    return rows.select(*geoms.columns, "_i", pose.alias("_p"))


def _poly3(i: Column) -> tuple[Column, Column]:
    c = F.col("g")["poly3"]
    u = F.col("_len") * i / F.col("_n")
    return u, _cubic([_zero(c[f"_{n}"]) for n in "abcd"], u)


def _param_poly3(i: Column) -> tuple[Column, Column]:
    c = F.col("g")["paramPoly3"]
    reach = F.when(F.coalesce(F.trim(c["_pRange"]) == "arcLength", F.lit(False)), F.col("_len")).otherwise(1.0)
    p = reach * i / F.col("_n")
    u = _cubic([_zero(c["_aU"]), _zero(c["_bU"], 1.0), _zero(c["_cU"]), _zero(c["_dU"])], p)
    return u, _cubic([_zero(c[f"_{n}V"]) for n in "abcd"], p)


def _cubic(k: list[Column], t: Column) -> Column:
    return k[0] + k[1] * t + k[2] * t * t + k[3] * t * t * t


def _bent(i: Column, local) -> Column:
    """Pose of a curve in the local frame; the heading is that of the last chord."""
    h0 = F.col("_hdg0")

    def world(at: Column) -> tuple[Column, Column]:
        u, v = local(at)
        return F.col("_x0") + F.cos(h0) * u - F.sin(h0) * v, F.col("_y0") + F.sin(h0) * u + F.cos(h0) * v

    x, y = world(i)
    end = F.greatest(i, F.lit(1))
    (xa, ya), (xb, yb) = world(end - 1), world(end)
    return F.struct(x.alias("x"), y.alias("y"), F.atan2(yb - ya, xb - xa).alias("hdg"))
