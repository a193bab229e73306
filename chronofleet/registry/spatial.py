"""Point-cloud, camera, box and path queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from chronofleet.functions import geometry as geo
from chronofleet.functions.numeric import finite_or_null
from chronofleet.operators import spatial as sp
from chronofleet.registry.common import PTS, T0, Query, r6, rounded, spins, sql6, table

XYZ = ("x", "y", "z")
S2 = math.sqrt(0.5)

# name, model, fx, fy, cx, cy, w, h, distortion, polynomial, translation, quaternion
_CAMERAS = [
    ("front", "pinhole", (900.0, 900.0, 640.0, 360.0), (1280, 720), (-0.1, 0.01, 0.001, -0.002, 0.0005), (), (0.1, -0.2, 5.0), (0.0, 0.0, 0.0, 1.0)),
    ("side", "pinhole", (700.0, 710.0, 320.0, 240.0), (640, 480), (), (), (0.0, 0.0, 2.0), (0.0, 0.5, 0.0, 0.75)),
    ("wide", "ftheta", (0.0, 0.0, 960.0, 600.0), (1920, 1200), (), (0.0, 600.0, 5.0, -90.0), (0.0, 0.0, 1.0), (0.25, 0.0, 0.0, 0.9)),
]

def cameras(spark, sf_dir):
    """The rig of every source that has spins."""
    fields = ("name", "model", "intrinsics", "resolution", "distortion", "forward_poly", "translation", "quaternion")

    def literal(v):
        return F.array(*[F.lit(x) for x in v]) if isinstance(v, tuple) else F.lit(v)

    def camera(c):
        return F.struct(*[literal(v).cast("array<double>" if isinstance(v, tuple) else "string").alias(n) for n, v in zip(fields, c)])

    logs = spins(spark, sf_dir).select("source_id").distinct()
    rig = logs.select("source_id", F.inline(F.array(*[camera(c) for c in _CAMERAS])))
    return rig.withColumn("resolution", F.col("resolution").cast("array<int>"))


def points(spark, sf_dir):
    return sp.explode_points(spins(spark, sf_dir))


def g1(spark, sf_dir):
    return rounded(points(spark, sf_dir), *XYZ, "intensity")


def g2(spark, sf_dir):
    p = points(spark, sf_dir)
    q = [F.lit(v) for v in (0.1, -0.2, 0.3, 0.9)]
    t = [F.lit(v) for v in (1.0, 2.0, 3.0)]
    out = geo.rotate_translate([F.col(c).cast("double") for c in XYZ], q, t)
    return p.select("source_id", "ts_ns", "point_idx", *[r6(c).alias(n) for c, n in zip(out, XYZ)])


def _rot(x: str, y: str, z: str, q: str = "c") -> list[str]:
    p = f"{q}." if q else ""
    qx, qy, qz, qw = (f"{p}{n}" for n in ("qx", "qy", "qz", "qw"))
    tx, ty, tz = f"(2*({qy}*{z}-{qz}*{y}))", f"(2*({qz}*{x}-{qx}*{z}))", f"(2*({qx}*{y}-{qy}*{x}))"
    return [f"({x}+{qw}*{tx}+({qy}*{tz}-{qz}*{ty}))", f"({y}+{qw}*{ty}+({qz}*{tx}-{qx}*{tz}))", f"({z}+{qw}*{tz}+({qx}*{ty}-{qy}*{tx}))"]


def _cam_values() -> str:
    rows = []
    for name, model, k, res, dist, poly, t, q in _CAMERAS:
        d = dist or (0.0,) * 5
        c = poly or (0.0,) * 4
        nums = [f"{v!r}::DOUBLE" for v in (*k, *d, *c, *t, *q)]
        rows.append(f"('{name}', '{model}', {res[0]}, {res[1]}, {', '.join(nums)})")
    cols = "camera, model, w, h, fx, fy, cx, cy, k1, k2, p1, p2, k3, c0, c1, c2, c3, tx, ty, tz, qx, qy, qz, qw"
    return f"cam({cols}) AS (VALUES {', '.join(rows)})"


def _limit() -> str:
    poly = "(((c3*{0}+c2)*{0}+c1)*{0}+c0)"
    a, b = poly.format("(i*0.01)"), poly.format("((i-1)*0.01)")
    return f"""lim AS (SELECT camera, coalesce((min(i) FILTER ({a} < {b}) - 1) * 0.01, {math.pi!r}) AS lim
      FROM cam, (SELECT range AS i FROM range(1, 315)) g GROUP BY camera)"""


_X, _Y, _Z = _rot("x::DOUBLE", "y::DOUBLE", "z::DOUBLE")
PROJECTED = f"""{PTS}, {_cam_values()}, {_limit()},
  a AS (SELECT source_id, channel_id, ts_ns, point_idx, c.*, lim, {_X} + c.tx AS px, {_Y} + c.ty AS py, {_Z} + c.tz AS pz FROM pts, cam c JOIN lim ON c.camera = lim.camera),
  n AS (SELECT *, px / nullif(pz, 0) AS nx, py / nullif(pz, 0) AS ny, sqrt(px*px + py*py) AS rxy, atan2(sqrt(px*px + py*py), pz) AS th FROM a),
  d AS (SELECT *, nx*nx + ny*ny AS r2 FROM n),
  e AS (SELECT *, 1 + k1*r2 + k2*r2*r2 + k3*r2*r2*r2 AS rad, ((c3*th + c2)*th + c1)*th + c0 AS rho FROM d),
  f AS (SELECT *, CASE WHEN pz <= 0 THEN NULL WHEN model = 'ftheta' THEN CASE WHEN th <= lim THEN cx + px * CASE WHEN rxy > 1e-9 THEN rho / rxy ELSE 0 END END
           ELSE fx * (nx*rad + 2*p1*nx*ny + p2*(r2 + 2*nx*nx)) + cx END AS u,
         CASE WHEN pz <= 0 THEN NULL WHEN model = 'ftheta' THEN CASE WHEN th <= lim THEN cy + py * CASE WHEN rxy > 1e-9 THEN rho / rxy ELSE 0 END END
           ELSE fy * (ny*rad + p1*(r2 + 2*ny*ny) + 2*p2*nx*ny) + cy END AS v FROM e),
  proj AS (SELECT source_id, channel_id, ts_ns, point_idx, camera, u, v, pz AS depth, coalesce(u >= 0 AND u < w AND v >= 0 AND v < h, false) AS visible FROM f)"""


def _projected(spark, sf_dir):
    return sp.project_points(points(spark, sf_dir), cameras(spark, sf_dir))


def _pixels(out):
    """Three places; pixels a million or more away are NULL, as their digits are noise."""
    near = {c: F.round(F.when(F.abs(c) < 1e6, finite_or_null(F.col(c))), 3) for c in ("u", "v")}
    return out.withColumns({**near, "depth": F.round("depth", 3)})


def g3(spark, sf_dir):
    out = _projected(spark, sf_dir).filter(F.col("camera") != "wide")
    out = out.select("source_id", "ts_ns", "point_idx", "camera", "u", "v", "depth", "visible")
    return _pixels(out)


def g4(spark, sf_dir):
    out = _projected(spark, sf_dir).filter(F.col("camera") == "wide")
    out = out.select("source_id", "ts_ns", "point_idx", "camera", "u", "v", "depth", "visible")
    return _pixels(out)


def _proj_sql(where: str) -> str:
    return f"""WITH {PROJECTED} SELECT source_id, ts_ns, point_idx, camera, round(CASE WHEN abs(u) < 1e6 THEN u END, 3) AS u,
      round(CASE WHEN abs(v) < 1e6 THEN v END, 3) AS v, round(depth, 3) AS depth, visible FROM proj WHERE {where}"""


def g5(spark, sf_dir):
    return rounded(sp.reprojection_stats(_projected(spark, sf_dir), ["channel_id", "camera"]), "front_pct", "image_pct")


def _sensors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    at = [F.get("embedding", F.lit(i)).cast("double") for i in range(14)]
    head = F.concat(F.lit("log-"), F.col("vec_id").cast("string")).alias("source_id")

    def row(role: str, o: int):
        return e.select(
            head, F.lit(f"{role}_0").alias("name"), F.lit(role).alias("role"), F.array(*at[o : o + 3]).alias("translation"), F.array(*at[o + 3 : o + 7]).alias("rotation")
        )

    return row("lidar", 0).unionByName(row("camera", 7))


def g6(spark, sf_dir):
    out = sp.compose_extrinsics(_sensors(spark, sf_dir))
    cols = [r6(F.get("translation", F.lit(i))).alias(n) for i, n in enumerate(("tx", "ty", "tz"))]
    cols += [r6(F.get("quaternion", F.lit(i))).alias(n) for i, n in enumerate(("qx", "qy", "qz", "qw"))]
    return out.select("source_id", "name", *cols)


def _matrix(p: str) -> str:
    w, x, y, z = (f"{p}{n}" for n in "wxyz")
    cells = [f"1-2*({y}*{y}+{z}*{z})", f"2*({x}*{y}-{z}*{w})", f"2*({x}*{z}+{y}*{w})", f"2*({x}*{y}+{z}*{w})", f"1-2*({x}*{x}+{z}*{z})",
             f"2*({y}*{z}-{x}*{w})", f"2*({x}*{z}-{y}*{w})", f"2*({y}*{z}+{x}*{w})", f"1-2*({x}*{x}+{y}*{y})"]
    return ", ".join(f"{c} AS {p}{i // 3}{i % 3}" for i, c in enumerate(cells))


def _compose_sql() -> str:
    def unit(p: str, o: int) -> str:
        n = "sqrt(" + " + ".join(f"embedding[{o + i}]::DOUBLE * embedding[{o + i}]::DOUBLE" for i in range(4)) + ")"
        return ", ".join(f"embedding[{o + i}]::DOUBLE / {n} AS {p}{a}" for i, a in enumerate("wxyz"))

    r = ", ".join(" + ".join(f"c{k}{i} * l{k}{j}" for k in range(3)) + f" AS r{i}{j}" for i in range(3) for j in range(3))
    t = ", ".join(" + ".join(f"c{k}{i} * (embedding[{k + 1}]::DOUBLE - embedding[{k + 8}]::DOUBLE)" for k in range(3)) + f" AS t{i}" for i in range(3))
    return f"""WITH q AS (SELECT *, {unit('l', 4)}, {unit('c', 11)} FROM embeddings),
      m AS (SELECT *, {_matrix('l')}, {_matrix('c')} FROM q),
      o AS (SELECT vec_id, {r}, {t} FROM m),
      s AS (SELECT *, r00 + r11 + r22 AS tr FROM o),
      b AS (SELECT *, CASE WHEN tr > 0 THEN 2 * sqrt(tr + 1) WHEN r00 > r11 AND r00 > r22 THEN 2 * sqrt(1 + r00 - r11 - r22)
                     WHEN r11 > r22 THEN 2 * sqrt(1 + r11 - r00 - r22) ELSE 2 * sqrt(1 + r22 - r00 - r11) END AS s FROM s),
      k AS (SELECT *,
        CASE WHEN tr > 0 THEN (r21 - r12) / s WHEN r00 > r11 AND r00 > r22 THEN 0.25 * s WHEN r11 > r22 THEN (r01 + r10) / s ELSE (r02 + r20) / s END AS qx,
        CASE WHEN tr > 0 THEN (r02 - r20) / s WHEN r00 > r11 AND r00 > r22 THEN (r01 + r10) / s WHEN r11 > r22 THEN 0.25 * s ELSE (r12 + r21) / s END AS qy,
        CASE WHEN tr > 0 THEN (r10 - r01) / s WHEN r00 > r11 AND r00 > r22 THEN (r02 + r20) / s WHEN r11 > r22 THEN (r12 + r21) / s ELSE 0.25 * s END AS qz,
        CASE WHEN tr > 0 THEN 0.25 * s WHEN r00 > r11 AND r00 > r22 THEN (r21 - r12) / s WHEN r11 > r22 THEN (r02 - r20) / s ELSE (r10 - r01) / s END AS qw FROM b)
      SELECT 'log-' || vec_id AS source_id, 'camera_0' AS name, {sql6('t0')} AS tx, {sql6('t1')} AS ty, {sql6('t2')} AS tz,
        {sql6('qx')} AS qx, {sql6('qy')} AS qy, {sql6('qz')} AS qz, {sql6('qw')} AS qw FROM k"""


EULER = ("embedding[1]::DOUBLE * 10", "embedding[2]::DOUBLE * 10", "embedding[3]::DOUBLE * 10")


def _angles():
    return [F.get("embedding", F.lit(i)).cast("double") * 10 for i in range(3)]


def g7(spark, sf_dir):
    q = geo.euler_to_quat(*_angles())
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(c.cast("double"), 4).alias(n) for c, n in zip(q, ("qx", "qy", "qz", "qw"))])


def _euler_sql() -> str:
    trig = ", ".join(f"cos({e} / 2) AS c{a}, sin({e} / 2) AS s{a}" for e, a in zip(EULER, "xyz"))
    return f"""WITH h AS (SELECT vec_id, {trig} FROM embeddings) SELECT vec_id, round((cz*cy*sx - sz*sy*cx)::FLOAT::DOUBLE, 4) AS qx,
      round((cz*sy*cx + sz*cy*sx)::FLOAT::DOUBLE, 4) AS qy, round((sz*cy*cx - cz*sy*sx)::FLOAT::DOUBLE, 4) AS qz, round((cz*cy*cx + sz*sy*sx)::FLOAT::DOUBLE, 4) AS qw FROM h"""


def g8(spark, sf_dir):
    w, x, y, z = (F.get("embedding", F.lit(i)).cast("double") * 5 for i in range(4))
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(geo.yaw(w, x, y, z)).alias("yaw"))


def boxes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v = [F.get("embedding", F.lit(i)).cast("double") for i in range(10)]
    norm = F.sqrt(v[6] * v[6] + v[7] * v[7] + v[8] * v[8] + v[9] * v[9])
    cols = [(v[i] * 100).alias(n) for i, n in enumerate(("cx", "cy", "cz"))]
    cols += [(F.abs(v[i]) * 20).alias(n) for i, n in zip((3, 4, 5), ("sx", "sy", "sz"))]
    cols += [(v[i] / norm).alias(n) for i, n in zip((6, 7, 8, 9), ("qx", "qy", "qz", "qw"))]
    return e.select("vec_id", "label", *cols)


BOXES = """b0 AS (SELECT vec_id, label, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM embeddings),
  box AS (SELECT vec_id, label, v[1]*100 AS cx, v[2]*100 AS cy, v[3]*100 AS cz, abs(v[4])*20 AS sx, abs(v[5])*20 AS sy, abs(v[6])*20 AS sz,
    v[7]/n AS qx, v[8]/n AS qy, v[9]/n AS qz, v[10]/n AS qw FROM (SELECT *, sqrt(v[7]*v[7]+v[8]*v[8]+v[9]*v[9]+v[10]*v[10]) AS n FROM b0))"""


def g9(spark, sf_dir):
    return rounded(sp.box_corners(boxes(spark, sf_dir)), *XYZ)


def _corner_sql() -> str:
    lx, ly, lz = (f"(CASE WHEN (corner & {1 << i}) <> 0 THEN {s} / 2 ELSE -{s} / 2 END)" for i, s in enumerate(("sx", "sy", "sz")))
    x, y, z = _rot("lx", "ly", "lz", "")
    return f"""WITH {BOXES}, l AS (SELECT *, {lx} AS lx, {ly} AS ly, {lz} AS lz FROM box, (SELECT range::INT AS corner FROM range(8)))
      SELECT vec_id, label, corner, {sql6(f'{x} + cx')} AS x, {sql6(f'{y} + cy')} AS y, {sql6(f'{z} + cz')} AS z FROM l"""


FRAME_COLS = ("center_x", "center_y", "center_z", "radius", "distance")


def g10(spark, sf_dir):
    return rounded(sp.scene_extent(points(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in XYZ}), ["channel_id"]), *FRAME_COLS)


def g10_boxes(spark, sf_dir):
    return rounded(sp.box_extent(boxes(spark, sf_dir), ["label"]), *FRAME_COLS)


def g10_cloud(spark, sf_dir):
    return rounded(sp.cloud_extent(points(spark, sf_dir), ["channel_id"]), *FRAME_COLS)


TAN30 = repr(math.tan(math.pi / 6))


def _framed(src: str, key: str) -> str:
    return f"""r AS (SELECT *, greatest(sqrt(((hx-lx)/2)**2 + ((hy-ly)/2)**2), (hz-lz)/2, 3.0) AS radius FROM {src})
      SELECT {key}, {sql6('(lx+hx)/2')} AS center_x, {sql6('(ly+hy)/2')} AS center_y, {sql6('(lz+hz)/2')} AS center_z, {sql6('radius')} AS radius,
      {sql6(f'greatest(8.0, radius / {TAN30} * 1.3)')} AS distance FROM r"""


def g11(spark, sf_dir):
    out = sp.normalise_intensity(points(spark, sf_dir), ["source_id", "channel_id", "ts_ns"])
    return out.select("source_id", "ts_ns", "point_idx", "intensity_u8")


def g11_range(spark, sf_dir):
    out = sp.normalise_intensity(points(spark, sf_dir), ["channel_id"], None)
    return out.select("source_id", "ts_ns", "point_idx", "intensity_u8")


def g12(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("depth", F.sqrt(sum(F.col(c).cast("double") * F.col(c).cast("double") for c in XYZ)))
    return sp.depth_histogram(p, 2.0, 40.0, ["channel_id"])


def g13(spark, sf_dir):
    """Checked as a whole: each spin keeps exactly its first draws."""
    p = points(spark, sf_dir)
    kept = sp.subsample_points(p, 9, 7, ["source_id", "ts_ns"])
    return kept.groupBy("source_id", "ts_ns").agg(F.count(F.lit(1)).alias("n_kept"), F.countDistinct("point_idx").alias("n_distinct"))


def _flat_paths(spark, sf_dir):
    s = spins(spark, sf_dir)
    pts = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(*[F.get("positions", i * 3 + k).alias(n) for k, n in enumerate(XYZ)]))
    n = (F.col("ts_ns") / 100_000_000).cast("bigint") % 5 + 3
    lengths = F.array(n, F.lit(6).cast("bigint"), F.lit(15).cast("bigint") - n).cast("array<int>")
    return s.select("source_id", "channel_id", "ts_ns", pts.alias("points"), lengths.alias("path_lengths"))


def g14(spark, sf_dir):
    out = sp.split_paths(_flat_paths(spark, sf_dir))
    rows = out.select("source_id", "ts_ns", "path_idx", F.posexplode("points").alias("i", "p"))
    return rows.select("source_id", "ts_ns", "path_idx", "i", *[r6(F.col("p")[c]).alias(c) for c in XYZ])


def g14_join(spark, sf_dir):
    again = sp.join_paths(sp.split_paths(_flat_paths(spark, sf_dir)), ["source_id", "ts_ns"])
    total = F.aggregate("points", F.lit(0.0), lambda a, p: a + p["x"].cast("double"))
    return again.select("source_id", "ts_ns", F.size("points").alias("n_points"), F.size("path_lengths").alias("n_paths"), F.round(total, 4).alias("sum_x"))


def g15(spark, sf_dir):
    paths = sp.split_paths(_flat_paths(spark, sf_dir))
    return sp.latest_frame(paths).select("channel_id", "source_id", "ts_ns", "path_idx", F.size("points").alias("n_points"))


NPATH = "(vec_id + 17040672000) % 5 + 3"
PATHS = f"""fp AS (SELECT 'log-' || (vec_id % 4) AS source_id, 'lidar-' || label AS channel_id, {T0} + vec_id * 100000000 AS ts_ns, i AS at,
    CASE WHEN i < {NPATH} THEN 0 WHEN i < {NPATH} + 6 THEN 1 ELSE 2 END AS path_idx,
    CASE WHEN i < {NPATH} THEN i WHEN i < {NPATH} + 6 THEN i - ({NPATH}) ELSE i - ({NPATH}) - 6 END AS i2,
    (embedding[3*i+1]::DOUBLE * 100.0)::FLOAT AS x, (embedding[3*i+2]::DOUBLE * 100.0)::FLOAT AS y, (embedding[3*i+3]::DOUBLE * 100.0)::FLOAT AS z
    FROM embeddings, (SELECT range::INT AS i FROM range(21)))"""

P6 = ", ".join(f"{sql6(c)} AS {c}" for c in XYZ)

QUERIES = {
    "g1_explode_points": Query(g1, f"WITH {PTS} SELECT source_id, channel_id, ts_ns, point_idx, {P6}, {sql6('intensity')} AS intensity FROM pts"),
    "g2_rotate_translate": Query(
        g2,
        f"""WITH {PTS}, c AS (SELECT 0.1::DOUBLE AS qx, -0.2::DOUBLE AS qy, 0.3::DOUBLE AS qz, 0.9::DOUBLE AS qw)
        SELECT source_id, ts_ns, point_idx, {sql6(_X + ' + 1.0')} AS x, {sql6(_Y + ' + 2.0')} AS y, {sql6(_Z + ' + 3.0')} AS z FROM pts, c""",
    ),
    "g3_project_pinhole": Query(g3, _proj_sql("camera <> 'wide'")),
    "g4_project_ftheta": Query(g4, _proj_sql("camera = 'wide'")),
    "g5_reprojection_stats": Query(
        g5,
        f"""WITH {PROJECTED} SELECT channel_id, camera, count(*) AS total, count(*) FILTER (depth > 0) AS in_front, count(*) FILTER (visible) AS in_image,
        {sql6('100.0 * count(*) FILTER (depth > 0) / count(*)')} AS front_pct, {sql6('100.0 * count(*) FILTER (visible) / count(*)')} AS image_pct
        FROM proj GROUP BY channel_id, camera""",
    ),
    "g6_compose_extrinsics": Query(g6, _compose_sql()),
    "g7_euler_to_quat": Query(g7, _euler_sql()),
    "g8_yaw": Query(
        g8,
        f"""WITH q AS (SELECT vec_id, embedding[1]::DOUBLE*5 AS w, embedding[2]::DOUBLE*5 AS x, embedding[3]::DOUBLE*5 AS y, embedding[4]::DOUBLE*5 AS z FROM embeddings)
        SELECT vec_id, {sql6('atan2(2*(w*z + x*y), 1 - 2*(y*y + z*z))')} AS yaw FROM q""",
    ),
    "g9_box_corners": Query(g9, _corner_sql()),
    "g10_scene_extent": Query(
        g10,
        f"WITH {PTS}, e AS (SELECT channel_id, min(x)::DOUBLE AS lx, max(x)::DOUBLE AS hx, min(y)::DOUBLE AS ly, max(y)::DOUBLE AS hy, min(z)::DOUBLE AS lz, max(z)::DOUBLE AS hz FROM pts GROUP BY 1), {_framed('e', 'channel_id')}",
    ),
    "g10_box_extent": Query(
        g10_boxes,
        f"""WITH {BOXES}, p AS (SELECT *, greatest(sx, sy, sz) / 2 AS pad FROM box),
        e AS (SELECT label, min(cx-pad) AS lx, max(cx+pad) AS hx, min(cy-pad) AS ly, max(cy+pad) AS hy, min(cz-pad) AS lz, max(cz+pad) AS hz FROM p GROUP BY 1), {_framed('e', 'label')}""",
    ),
    "g10_cloud_extent": Query(
        g10_cloud,
        f"""WITH {PTS}, c AS (SELECT channel_id, avg(x::DOUBLE) AS cx, avg(y::DOUBLE) AS cy, avg(z::DOUBLE) AS cz FROM pts GROUP BY 1),
        d AS (SELECT channel_id, sqrt((x-cx)**2 + (y-cy)**2) AS r FROM pts JOIN c USING (channel_id)),
        q AS (SELECT channel_id, list_sort(list(r))[floor(count(*) * 0.9)::BIGINT + 1] AS r FROM d GROUP BY 1)
        SELECT channel_id, {sql6('cx')} AS center_x, {sql6('cy')} AS center_y, {sql6('cz')} AS center_z, {sql6('r')} AS radius,
        {sql6(f'greatest(8.0, r / {TAN30} * 1.25)')} AS distance FROM c JOIN q USING (channel_id)""",
    ),
    "g11_normalise_intensity": Query(
        g11,
        f"""WITH {PTS}, w AS (SELECT *, min(intensity) OVER p AS lo, max(intensity) OVER p AS hi FROM pts WINDOW p AS (PARTITION BY source_id, channel_id, ts_ns))
        SELECT source_id, ts_ns, point_idx, CASE WHEN hi > lo THEN round((intensity::DOUBLE - lo::DOUBLE) / (hi::DOUBLE - lo::DOUBLE) * 255.0)::SMALLINT ELSE 128 END AS intensity_u8 FROM w""",
    ),
    "g11_range_intensity": Query(
        g11_range,
        f"""WITH {PTS}, g AS (SELECT *, sqrt(x::DOUBLE*x::DOUBLE + y::DOUBLE*y::DOUBLE + z::DOUBLE*z::DOUBLE) AS r FROM pts),
        w AS (SELECT *, min(r) OVER p AS lo, max(r) OVER p AS hi FROM g WINDOW p AS (PARTITION BY channel_id))
        SELECT source_id, ts_ns, point_idx, CASE WHEN hi > lo THEN round((r - lo) / (hi - lo) * 255.0)::SMALLINT ELSE 128 END AS intensity_u8 FROM w""",
    ),
    "g12_depth_histogram": Query(
        g12,
        f"""WITH {PTS}, g AS (SELECT channel_id, sqrt(x::DOUBLE*x::DOUBLE + y::DOUBLE*y::DOUBLE + z::DOUBLE*z::DOUBLE) AS r FROM pts)
        SELECT channel_id, floor((greatest(2.0, least(40.0, r)) - 2.0) / 38.0 * 63 + 0.5)::INT AS bucket, count(*) AS n_points FROM g GROUP BY 1, 2""",
    ),
    "g13_subsample_points": Query(g13, f"WITH {PTS} SELECT source_id, ts_ns, 9::BIGINT AS n_kept, 9::BIGINT AS n_distinct FROM pts GROUP BY 1, 2"),
    "g14_split_paths": Query(g14, f"WITH {PATHS} SELECT source_id, ts_ns, path_idx, i2 AS i, {P6} FROM fp"),
    "g14_join_paths": Query(g14_join, f"WITH {PATHS} SELECT source_id, ts_ns, count(*) AS n_points, count(DISTINCT path_idx) AS n_paths, round(sum(x::DOUBLE), 4) AS sum_x FROM fp GROUP BY 1, 2"),
    "g15_latest_frame": Query(
        g15,
        f"""WITH {PATHS}, m AS (SELECT source_id, channel_id, max(ts_ns) AS ts_ns FROM fp GROUP BY ALL)
        SELECT channel_id, source_id, ts_ns, path_idx, count(*) AS n_points FROM fp JOIN m USING (source_id, channel_id, ts_ns) GROUP BY ALL""",
    ),
}
