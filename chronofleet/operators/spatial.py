"""Point clouds, cameras, boxes and paths."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofleet.functions.geometry import horner, normalised, quat_product, rotate, rotate_translate
from chronofleet.functions.numeric import double_to_long, is_finite, nan, round_half_up
from chronofleet.plans.scan import OrderedScan

# View geometry of scene framing and depth shading.
FOV_HALF = math.pi / 6
MIN_RADIUS, MIN_DISTANCE = 3.0, 8.0
BOX_MARGIN, CLOUD_MARGIN, CLOUD_DEFAULT_RADIUS = 1.3, 1.25, 10.0
DEPTH_BUCKETS = 64
THETA_STEP = 0.01


def explode_points(spins: DataFrame) -> DataFrame:
    """One row per point; intensity is scaled from 0..255 to 0..1."""
    rest = [c for c in spins.columns if c not in ("positions", "intensities")]
    rows = spins.select(*rest, "positions", F.posexplode("intensities").alias("point_idx", "_i"))
    at = [F.get("positions", F.col("point_idx") * 3 + k).alias(n) for k, n in enumerate("xyz")]
    return rows.select(*rest, "point_idx", *at, (F.col("_i") / F.lit(255.0)).cast("float").alias("intensity"))


def ftheta_limits(cameras: DataFrame) -> DataFrame:
    """Adds ``max_theta``: the last angle before the lens polynomial first decreases."""
    steps = int(math.pi / THETA_STEP)
    grid = F.sequence(F.lit(1), F.lit(steps))
    poly = F.col("forward_poly")
    falls = F.filter(grid, lambda i: horner(poly, i * THETA_STEP) < horner(poly, (i - 1) * THETA_STEP))
    first = F.get(falls, F.lit(0))
    limit = F.when(F.col("model") == "ftheta", F.coalesce((first - 1) * F.lit(THETA_STEP), F.lit(math.pi)))
    return cameras.withColumn("max_theta", limit)


def project_points(points: DataFrame, cameras: DataFrame, on: Sequence[str] = ("source_id",)) -> DataFrame:
    """Every point through every camera of its own source.

    Adds camera ``name``, pixel ``u, v``, camera-frame ``depth`` and ``visible``. Points
    behind the camera, or outside the usable f-theta field, get NaN pixels. The join key
    ties a log's points to that log's calibration; Spark broadcasts the calibrations
    when they are small and shuffles by key otherwise.
    """
    cams = ftheta_limits(cameras).select(
        *on,
        F.col("name").alias("camera"),
        "model",
        F.col("intrinsics").cast("array<double>").alias("_k"),
        F.col("resolution").alias("_res"),
        F.col("distortion").cast("array<double>").alias("_dist"),
        F.col("forward_poly").cast("array<double>").alias("_poly"),
        F.col("translation").cast("array<double>").alias("_t"),
        F.col("quaternion").cast("array<double>").alias("_q"),
        F.col("max_theta").alias("_limit"),
    )
    joined = points.join(cams, list(on))
    own = [F.col(c).cast("double") for c in "xyz"]
    q, t = ([F.get("_q", F.lit(i)) for i in range(4)], [F.get("_t", F.lit(i)) for i in range(3)])
    xc, yc, zc = rotate_translate(own, q, t)
    placed = joined.withColumns({"_x": xc, "_y": yc, "_z": zc})
    x, y, z = F.col("_x"), F.col("_y"), F.col("_z")
    fx, fy, cx, cy = (F.get("_k", F.lit(i)) for i in range(4))
    front = z > 0
    safe_z = F.when(front, z)
    nx, ny = x / safe_z, y / safe_z
    r2 = nx * nx + ny * ny
    k1, k2, p1, p2, k3 = (F.get("_dist", F.lit(i)) for i in range(5))
    radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
    bent = F.size("_dist") == 5
    dx = F.when(bent, nx * radial + 2 * p1 * nx * ny + p2 * (r2 + 2 * nx * nx)).otherwise(nx)
    dy = F.when(bent, ny * radial + p1 * (r2 + 2 * ny * ny) + 2 * p2 * nx * ny).otherwise(ny)
    rxy = F.sqrt(x * x + y * y)
    theta = F.atan2(rxy, z)
    fold = F.when(rxy > 1e-9, horner(F.col("_poly"), theta) / F.when(rxy > 1e-9, rxy)).otherwise(0.0)
    wide = F.col("model") == "ftheta"
    seen = front & F.when(wide, theta <= F.col("_limit")).otherwise(True)
    u = F.when(seen, F.when(wide, cx + x * fold).otherwise(fx * dx + cx))
    v = F.when(seen, F.when(wide, cy + y * fold).otherwise(fy * dy + cy))
    out = placed.withColumns({"u": F.coalesce(u, nan()), "v": F.coalesce(v, nan()), "depth": z})
    inside = ~F.isnan("u") & (F.col("u") >= 0) & (F.col("u") < F.get("_res", F.lit(0)))
    inside = inside & (F.col("v") >= 0) & (F.col("v") < F.get("_res", F.lit(1)))
    out = out.withColumn("visible", inside)
    return out.drop("_k", "_res", "_dist", "_poly", "_t", "_q", "_limit", "_x", "_y", "_z", "model")


def reprojection_stats(projected: DataFrame, by: Sequence[str] = ("source_id", "ts_ns", "camera")) -> DataFrame:
    """Points in total, in front of the camera and inside its image, with percentages."""
    total = F.count(F.lit(1))
    front, image = F.count_if(F.col("depth") > 0), F.count_if("visible")
    return projected.groupBy(*by).agg(
        total.alias("total"),
        front.alias("in_front"),
        image.alias("in_image"),
        (front * 100.0 / total).alias("front_pct"),
        (image * 100.0 / total).alias("image_pct"),
    )


def compose_extrinsics(sensors: DataFrame, on: Sequence[str] = ("source_id",), lidar: str = "lidar") -> DataFrame:
    """Camera-from-lidar pose of every camera: inverse(ego<-camera) after (ego<-lidar).

    ``sensors(on, name, role, translation, rotation)`` with scalar-first rotations and
    role ``lidar`` or ``camera``. Output quaternions are scalar-last and unit length.
    """
    def pick(role: str, prefix: str) -> DataFrame:
        return sensors.filter(F.col("role") == role).select(
            *on, F.col("name").alias(f"{prefix}name"),
            F.col("translation").alias(f"{prefix}t"), F.col("rotation").alias(f"{prefix}r"),
        )

    joined = pick("camera", "c_").join(pick(lidar, "l_").drop("l_name"), list(on))

    def parts(prefix: str) -> tuple[list[Column], list[Column]]:
        t = [F.get(f"{prefix}t", F.lit(i)).cast("double") for i in range(3)]
        return t, [F.get(f"{prefix}r", F.lit(i)).cast("double") for i in (1, 2, 3, 0)]

    # Each stage is named, so no expression is repeated inside the next one.
    ct, cr = parts("c_")
    lt, lr = parts("l_")
    staged = joined.withColumns({"_c": F.array(*normalised(cr)), "_l": F.array(*normalised(lr))})
    cq, lq = ([F.get(n, F.lit(i)) for i in range(4)] for n in ("_c", "_l"))
    inverse = (-cq[0], -cq[1], -cq[2], cq[3])
    shifted = rotate([a - b for a, b in zip(lt, ct)], inverse)
    staged = staged.withColumns({"_t": F.array(*shifted), "_q": F.array(*quat_product(inverse, lq))})
    staged = staged.withColumn("_u", F.array(*normalised([F.get("_q", F.lit(i)) for i in range(4)])))
    # The same rotation has two quaternions; the one a matrix conversion yields is kept:
    # positive w when the trace is positive, else a positive largest vector part.
    x, y, z, w = (F.get("_u", F.lit(i)) for i in range(4))
    lead = F.when(4 * w * w - 1 > 0, w).when((x * x > y * y) & (x * x > z * z), x).when(y * y > z * z, y).otherwise(z)
    staged = staged.withColumn("_sign", F.when(lead < 0, -1.0).otherwise(1.0))
    return staged.select(
        *on,
        F.col("c_name").alias("name"),
        F.col("_t").alias("translation"),
        F.array(*[c * F.col("_sign") for c in (x, y, z, w)]).alias("quaternion"),
    )


def box_corners(boxes: DataFrame) -> DataFrame:
    """Eight rows per box; bit 0, 1, 2 of ``corner`` selects the far side in x, y, z."""
    rows = boxes.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(7))))
    local = []
    for bit, size in enumerate(("sx", "sy", "sz")):
        far = F.col("corner").bitwiseAND(F.lit(1 << bit)) != 0
        local.append(F.when(far, F.col(size) / 2.0).otherwise(-F.col(size) / 2.0))
    q = [F.col(c).cast("double") for c in ("qx", "qy", "qz", "qw")]
    centre = [F.col(c).cast("double") for c in ("cx", "cy", "cz")]
    x, y, z = rotate_translate(local, q, centre)
    drop = ("cx", "cy", "cz", "sx", "sy", "sz", "qx", "qy", "qz", "qw")
    return rows.withColumns({"x": x, "y": y, "z": z}).drop(*drop)


def _framed(agg: DataFrame, by: Sequence[str]) -> DataFrame:
    mid = [((F.col(f"_lo{a}") + F.col(f"_hi{a}")) / 2).alias(f"center_{a}") for a in "xyz"]
    half = [(F.col(f"_hi{a}") - F.col(f"_lo{a}")) / 2 for a in "xyz"]
    radius = F.greatest(F.hypot(half[0], half[1]), half[2], F.lit(MIN_RADIUS))
    out = agg.select(*by, *mid, radius.alias("radius"))
    return out.withColumn("distance", F.greatest(F.lit(MIN_DISTANCE), F.col("radius") / math.tan(FOV_HALF) * BOX_MARGIN))


def scene_extent(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Centre, radius and viewing distance of the bounding box of ``x, y, z``."""
    aggs = [f(a).alias(f"_{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    return _framed(points.groupBy(*by).agg(*aggs), by)


def box_extent(boxes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Like :func:`scene_extent` with each box padded by its largest half size."""
    pad = F.greatest(*[F.abs(F.col(c)) / 2.0 for c in ("sx", "sy", "sz")])
    aggs = []
    for a, c in zip("xyz", ("cx", "cy", "cz")):
        aggs += [F.min(F.col(c) - pad).alias(f"_lo{a}"), F.max(F.col(c) + pad).alias(f"_hi{a}")]
    return _framed(boxes.groupBy(*by).agg(*aggs), by)


def cloud_extent(points: DataFrame, by: Sequence[str], target_rows: int | None = None) -> DataFrame:
    """Centroid and 90th-percentile horizontal radius of a cloud, over all its points."""
    by = list(by)
    centre = points.groupBy(*by).agg(
        *[F.avg(F.col(a).cast("double")).alias(f"center_{a}") for a in "xyz"], F.count(F.lit(1)).alias("_n")
    )
    r = F.hypot(F.col("x") - F.col("center_x"), F.col("y") - F.col("center_y"))
    radii = points.join(centre, by).select(*by, r.alias("_r"), "_n").withColumn("_key", double_to_long(F.col("_r") * 1e3))
    # An integer key that never decreases with the radius orders the scan; the radius
    # itself breaks its ties and splits a cell of equal keys.
    ranked = OrderedScan(radii, by, "_key", ["_r"], target_rows, F.col("_r")).rank("_i").run()
    picked = ranked.filter(F.col("_i") == F.floor(F.col("_n") * 9 / 10) + 1).select(*by, "_r")
    out = centre.join(picked, by, "left")
    radius = F.when(F.col("_r") > 0, F.col("_r")).otherwise(CLOUD_DEFAULT_RADIUS)
    out = out.withColumn("radius", radius)
    out = out.withColumn("distance", F.greatest(F.lit(MIN_DISTANCE), F.col("radius") / math.tan(FOV_HALF) * CLOUD_MARGIN))
    return out.select(*by, "center_x", "center_y", "center_z", "radius", "distance")


def normalise_intensity(points: DataFrame, by: Sequence[str], intensity: str | None = "intensity") -> DataFrame:
    """Per cloud, intensity stretched to 0..255; a flat cloud becomes 128.

    Points with a non-finite coordinate are dropped, a non-finite intensity counts as 0,
    and without an intensity column the range from the origin is used.
    """
    by = list(by)
    x, y, z = (F.col(a).cast("double") for a in "xyz")
    kept = points.filter(is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("z")))
    if intensity is None:
        raw = F.sqrt(x * x + y * y + z * z)
    else:
        raw = F.when(is_finite(F.col(intensity)), F.col(intensity).cast("double")).otherwise(0.0)
    kept = kept.withColumn("_raw", raw)
    span = kept.groupBy(*by).agg(F.min("_raw").alias("_lo"), F.max("_raw").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    level = F.round((F.col("_raw") - F.col("_lo")) / F.when(width > 0, width) * 255.0)
    scaled = F.when(width > 0, F.greatest(F.lit(0.0), F.least(F.lit(255.0), level))).otherwise(128.0)
    return kept.join(span, by).withColumn("intensity_u8", scaled.cast("smallint")).drop("_raw", "_lo", "_hi")


def depth_bucket(depth: Column, near: float, far: float, buckets: int = DEPTH_BUCKETS) -> Column:
    """Index of the depth shade: clamped to ``[near, far]``, nearest of ``buckets`` levels."""
    buckets = max(2, int(buckets))
    clamped = F.greatest(F.lit(float(near)), F.least(F.lit(float(far)), depth))
    share = (clamped - near) / (far - near) if far > near else F.lit(0.0)
    return round_half_up(share * (buckets - 1)).cast("int")


def depth_histogram(points: DataFrame, near: float, far: float, by: Sequence[str] = (), buckets: int = DEPTH_BUCKETS) -> DataFrame:
    bucket = depth_bucket(F.col("depth").cast("double"), near, far, buckets)
    return points.withColumn("bucket", bucket).groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n_points"))


def subsample_points(points: DataFrame, k: int, seed: int, by: Sequence[str] = ("source_id", "channel_id", "ts_ns"), target_rows: int | None = None) -> DataFrame:
    """At most ``k`` points per spin, uniform without replacement, stable across retries.

    A hash of (seed, spin, point) orders the draw, so a re-run task picks the same
    points. The ``point_idx`` column keeps the original order.
    """
    by = list(by)
    draw = points.withColumn("_draw", F.xxhash64(F.lit(seed), *by, "point_idx"))
    ranked = OrderedScan(draw, by, "_draw", ["point_idx"], target_rows).rank("_rank").run()
    return ranked.filter(F.col("_rank") <= k).drop("_draw", "_rank")


# -- paths -----------------------------------------------------------------------
def split_paths(df: DataFrame) -> DataFrame:
    """Flat ``points`` cut into one row per path by ``path_lengths``.

    A frame whose lengths do not add up to its points fails the job.
    """
    total = F.aggregate("path_lengths", F.lit(0), lambda a, n: a + n.cast("int"))
    checked = df.withColumn(
        "path_lengths",
        F.when(total == F.size("points"), F.col("path_lengths")).otherwise(
            F.raise_error(F.lit("path_lengths do not add up to the number of points")).cast("array<int>")
        ),
    )
    lengths = F.col("path_lengths")
    rows = checked.withColumn("_all", lengths).select(
        "*", F.posexplode("path_lengths").alias("path_idx", "_n")
    )
    before = F.aggregate(F.slice("_all", F.lit(1), F.col("path_idx")), F.lit(0), lambda a, n: a + n.cast("int"))
    path = F.slice("points", before + 1, F.col("_n"))
    return rows.withColumn("path", path).drop("points", "path_lengths", "_all", "_n").withColumnRenamed("path", "points")


def join_paths(paths: DataFrame, by: Sequence[str]) -> DataFrame:
    """The inverse: per frame the flat ``points`` with their ``path_lengths``."""
    packed = paths.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("path_idx", "points"))).alias("_p"))
    flat = F.flatten(F.transform("_p", lambda p: p["points"]))
    return packed.select(*by, flat.alias("points"), F.transform("_p", lambda p: F.size(p["points"])).alias("path_lengths"))


def latest_frame(paths: DataFrame, by: Sequence[str] = ("source_id", "channel_id")) -> DataFrame:
    """All paths of the newest frame of each channel."""
    newest = paths.groupBy(*by).agg(F.max("ts_ns").alias("ts_ns"))
    return paths.join(newest, [*by, "ts_ns"])
