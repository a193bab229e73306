"""Range, as-of and interval queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from chronofleet.operators import frames as fr
from chronofleet.operators import ranges as rg
from chronofleet.registry.common import DAY, T0, TARGET, TEL, Query, new_folder, r6, rounded, spins, sql6, table, telemetry
from chronofleet.sources import sinks

START, END = T0 + 10 * DAY, T0 + 12 * DAY
CURSOR = T0 + 15 * DAY + 12_345_678_901
HOUR = 3_600_000_000_000
VALUE = sql6("value")
COLS = f"source_id, channel_id, ts_ns, seq, {VALUE} AS value"


def frames(spark, sf_dir):
    """Video-like frames: one channel per source, a keyframe every 12th frame."""
    t = telemetry(spark, sf_dir)
    return t.select(
        F.col("source_id").alias("channel_id"), F.col("seq").alias("decode_idx"),
        (F.lit(T0) + F.col("seq") * 33_333_333).alias("pts_ns"), (F.col("seq") % 12 == 0).alias("is_key"),
    )


FRAMES = f"fr AS (SELECT source_id AS channel_id, seq AS decode_idx, {T0} + seq * 33333333 AS pts_ns, seq % 12 = 0 AS is_key FROM tel)"


def _sources(spark):
    rows = [("log-0", "tabular", 0), ("log-1", "tabular", 5 * HOUR), ("log-2", "tabular", -7 * HOUR), ("log-3", "video", 9 * HOUR)]
    return spark.createDataFrame(rows, "source_id string, kind string, time_offset_ns bigint")


SOURCES = f"src(source_id, shift) AS (VALUES ('log-0', 0::BIGINT), ('log-1', {5 * HOUR}), ('log-2', -{7 * HOUR}), ('log-3', 0))"


def _windows(spark, sf_dir):
    """One window per purchase, of a length that follows its value."""
    t = telemetry(spark, sf_dir).filter(F.col("channel_id") == "purchase")
    length = (F.col("seq") % 7 + 1) * HOUR
    return t.select(F.col("seq").alias("window_id"), "source_id", F.col("ts_ns").alias("start_ns"), (F.col("ts_ns") + length).alias("end_ns"))


WINDOWS = f"""win AS (SELECT seq AS window_id, source_id, ts_ns AS start_ns, ts_ns + (seq % 7 + 1) * {HOUR} AS end_ns
  FROM tel WHERE channel_id = 'purchase')"""


def r1(spark, sf_dir):
    return rounded(rg.fetch_range(telemetry(spark, sf_dir), ["click", "error"], START, END), "value")


def r2(spark, sf_dir):
    return rounded(rg.fetch_range(telemetry(spark, sf_dir), ["click", "error"], START, END, include_prev=True), "value")


def r3(spark, sf_dir):
    samples = rounded(telemetry(spark, sf_dir), "value")  # once per sample, not per pair
    out = rg.fetch_ranges(samples, _windows(spark, sf_dir), ["source_id"])
    return out.select("window_id", "source_id", "channel_id", "ts_ns", "seq", "value")


def r4(spark, sf_dir):
    return rounded(rg.sample_at(telemetry(spark, sf_dir), CURSOR), "value")


def r5(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    enums = t.select(F.concat(F.lit("state-"), "source_id").alias("source_id"), "channel_id", "ts_ns", "seq", (F.col("seq") % 3).cast("int").alias("code"))
    out = rg.snapshot_at(CURSOR, scalars=t, enums=enums, spins=spins(spark, sf_dir))
    return out.select("source_id", "channel_id", "kind", "sample_count", "held_ts_ns", r6("held_value").alias("held_value"))


def _lake(spark, sf_dir):
    """The samples written as a lake and read back, with the histogram stored beside them."""
    samples, path = telemetry(spark, sf_dir), new_folder(spark)
    sinks.write_samples(samples, path, 8)
    return sinks.read_samples(spark, path, samples.schema), sinks.read_histogram(spark, path)


def r2_lake(spark, sf_dir):
    lake, histogram = _lake(spark, sf_dir)
    return rounded(rg.fetch_range(lake, ["click", "error"], START, END, include_prev=True, histogram=histogram).select("source_id", "channel_id", "ts_ns", "seq", "value"), "value")


def r4_lake(spark, sf_dir):
    lake, histogram = _lake(spark, sf_dir)
    return rounded(rg.sample_at(lake, CURSOR, histogram=histogram).select("source_id", "channel_id", "ts_ns", "seq", "value"), "value")


def vectors(spark, sf_dir):
    """Three components of each embedding as a vector channel, several at one time."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("log-"), (F.col("vec_id") % 4).cast("string")).alias("source_id"), F.concat(F.lit("vec-"), (F.col("label") % 3).cast("string")).alias("channel_id"),
        (F.lit(T0) + F.expr("vec_id div 3") * 5_000_000_000_000).alias("ts_ns"), F.col("vec_id").alias("seq"), F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("value"),
    )


def r5_many(spark, sf_dir, target=None):
    """The snapshot at every purchase of a source."""
    t = telemetry(spark, sf_dir)
    enums = t.select("source_id", F.concat(F.lit("state-"), "channel_id").alias("channel_id"), "ts_ns", "seq", (F.col("seq") % 3).cast("int").alias("code"))
    video = frames(spark, sf_dir).withColumnRenamed("channel_id", "source_id").withColumn("channel_id", F.lit("cam"))
    times = t.filter(F.col("channel_id") == "purchase").select("source_id", F.col("ts_ns").alias("t_ns"), F.col("seq").alias("snapshot_id"))
    out = rg.snapshot_many(times, scalars=t, enums=enums, vectors=vectors(spark, sf_dir), spins=spins(spark, sf_dir), frames=video, target_rows=target)
    held = [r6(F.get("held_vector", F.lit(i))).alias(f"held_{i}") for i in range(3)]
    return out.select("snapshot_id", "source_id", "t_ns", "channel_id", "kind", "sample_count", "held_ts_ns", r6("held_value").alias("held_value"), *held)


def r6_vectors(spark, sf_dir, target=None):
    """For every click the latest vector of its source: a payload that doesn't travel with the scan."""
    clicks = telemetry(spark, sf_dir).filter(F.col("channel_id") == "click").select("source_id", "ts_ns", F.col("seq").alias("click_seq"))
    out = rg.asof_join(clicks, vectors(spark, sf_dir), ["source_id"], values=["seq", "value"], target_rows=target)
    held = [r6(F.get("right_value", F.lit(i))).alias(f"v{i}") for i in range(3)]
    return out.select("source_id", "ts_ns", "click_seq", F.col("right_ts_ns").alias("vector_ts_ns"), F.col("right_seq").alias("vec_id"), *held)


def r6_asof(spark, sf_dir, target=None):
    t = telemetry(spark, sf_dir)
    clicks = t.filter(F.col("channel_id") == "click").select("source_id", "ts_ns", F.col("seq").alias("click_seq"))
    errors = t.filter(F.col("channel_id") == "error")
    out = rg.asof_join(clicks, errors, ["source_id"], values=["seq", "value"], target_rows=target)
    return rounded(out.withColumnsRenamed({"right_ts_ns": "error_ts_ns", "right_seq": "error_seq", "right_value": "error_value"}), "error_value")


def r6_tolerance(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    left = t.select("source_id", "ts_ns", F.col("seq").alias("trigger_seq"))
    signups = t.filter(F.col("channel_id") == "signup")
    out = rg.asof_join(left, signups, ["source_id"], values=["seq"], tolerance_ns=HOUR)
    return out.withColumnsRenamed({"right_ts_ns": "match_ts_ns", "right_seq": "match_seq"})


def r7(spark, sf_dir):
    out = rg.fetch_range_with_offsets(telemetry(spark, sf_dir), _sources(spark), START, END)
    return rounded(out.select("source_id", "channel_id", "ts_ns", "seq", "value"), "value")


def r7_apply(spark, sf_dir):
    out = rg.apply_offsets(telemetry(spark, sf_dir), _sources(spark))
    return out.groupBy("source_id", "channel_id").agg(F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.sum("seq").alias("seq_sum"))


def r8(spark, sf_dir):
    return fr.keyframe_at(frames(spark, sf_dir), T0 + 55_555_555_555, ["channel_id"])


def r9(spark, sf_dir):
    return fr.frames_from(frames(spark, sf_dir), T0 + 55_555_555_555, ["channel_id"])


def r11(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    events = t.filter(F.col("channel_id") == "error").select(
        F.col("seq").alias("event_no"), "source_id", F.col("ts_ns").alias("ns"),
        ((F.col("seq") % 5) * HOUR).alias("before_ns"), ((F.col("seq") % 3) * HOUR).alias("after_ns"),
    )
    clicks = rounded(t.filter(F.col("channel_id") == "click"), "value")  # once per click, not per pair
    return rg.slice_events(clicks, events).select("event_no", "source_id", "ts_ns", "seq", "value")


def r12(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return rounded(t.orderBy("ts_ns", "seq"), "value")


def r13(spark, sf_dir):
    return fr.coverage_ranges(frames(spark, sf_dir), ["channel_id"])


def r14(spark, sf_dir):
    w = _windows(spark, sf_dir).withColumn("kind", F.concat(F.lit("w"), F.lpad(F.col("window_id").cast("string"), 9, "0")))
    return rg.coalesce_intervals(w, ["source_id"], T0 + DAY, T0 + 25 * DAY)


VECTORS = f"""vec AS (SELECT 'log-' || (vec_id % 4) AS source_id, 'vec-' || (label % 3) AS channel_id, {T0} + (vec_id // 3) * 5000000000000 AS ts_ns,
  vec_id AS seq, list_transform(embedding[1:3], lambda x: x::DOUBLE) AS value FROM embeddings)"""

QUERIES = {
    "r1_fetch_range": Query(r1, f"WITH {TEL} SELECT {COLS} FROM tel WHERE channel_id IN ('click', 'error') AND ts_ns >= {START} AND ts_ns < {END}"),
    "r2_fetch_range_prev": Query(
        r2,
        f"""WITH {TEL}, t AS (SELECT * FROM tel WHERE channel_id IN ('click', 'error')),
        prev AS (SELECT *, row_number() OVER (PARTITION BY source_id, channel_id ORDER BY ts_ns DESC, seq DESC) AS rn FROM t WHERE ts_ns < {START})
        SELECT {COLS} FROM t WHERE ts_ns >= {START} AND ts_ns < {END}
        UNION ALL SELECT {COLS} FROM prev WHERE rn = 1""",
    ),
    "r3_fetch_ranges": Query(
        r3,
        f"""WITH {TEL}, {WINDOWS} SELECT window_id, tel.source_id, channel_id, ts_ns, seq, {VALUE} AS value
        FROM win JOIN tel ON win.source_id = tel.source_id AND ts_ns >= start_ns AND ts_ns < end_ns""",
    ),
    "r4_sample_at": Query(
        r4,
        f"""WITH {TEL}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id, channel_id ORDER BY ts_ns DESC, seq DESC) AS rn
        FROM tel WHERE ts_ns <= {CURSOR}) SELECT {COLS} FROM r WHERE rn = 1""",
    ),
    "r5_snapshot": Query(
        r5,
        f"""WITH {TEL}, a AS (
          SELECT source_id, channel_id, 'scalar' AS kind, ts_ns, seq, value FROM tel
          UNION ALL SELECT 'state-' || source_id, channel_id, 'enum', ts_ns, seq, (seq % 3)::DOUBLE FROM tel
          UNION ALL SELECT 'log-' || (vec_id % 4), 'lidar-' || label, 'point_cloud', {T0} + vec_id * 100000000, 0, NULL FROM embeddings),
        n AS (SELECT source_id, channel_id, kind, count(*) AS sample_count FROM a GROUP BY ALL),
        h AS (SELECT *, row_number() OVER (PARTITION BY source_id, channel_id, kind ORDER BY ts_ns DESC, seq DESC) AS rn FROM a WHERE ts_ns <= {CURSOR})
        SELECT n.source_id, n.channel_id, n.kind, sample_count, h.ts_ns AS held_ts_ns, {VALUE} AS held_value
        FROM n LEFT JOIN h ON rn = 1 AND n.source_id = h.source_id AND n.channel_id = h.channel_id AND n.kind = h.kind""",
    ),
    "r5_snapshot_many": Query(
        r5_many,
        f"""WITH {TEL}, {VECTORS}, a AS (
          SELECT source_id, channel_id, 'scalar' AS kind, ts_ns, seq, value, NULL::DOUBLE[] AS v FROM tel
          UNION ALL SELECT source_id, 'state-' || channel_id, 'enum', ts_ns, seq, (seq % 3)::DOUBLE, NULL FROM tel
          UNION ALL SELECT source_id, 'cam', 'video', {T0} + seq * 33333333, seq, NULL, NULL FROM tel
          UNION ALL SELECT source_id, channel_id, 'vector', ts_ns, seq, NULL, value FROM vec
          UNION ALL SELECT 'log-' || (vec_id % 4), 'lidar-' || label, 'point_cloud', {T0} + vec_id * 100000000, 0, NULL, NULL FROM embeddings),
        n AS (SELECT source_id, channel_id, kind, count(*) AS sample_count FROM a GROUP BY ALL),
        o AS (SELECT source_id, channel_id, kind, ts_ns, arg_max({{'x': value}}, seq).x AS value, arg_max({{'x': v}}, seq).x AS v FROM a GROUP BY ALL),
        w AS (SELECT t.seq AS snapshot_id, t.ts_ns AS t_ns, n.* FROM tel t JOIN n USING (source_id) WHERE t.channel_id = 'purchase')
        SELECT snapshot_id, w.source_id, w.t_ns, w.channel_id, w.kind, sample_count, o.ts_ns AS held_ts_ns, {sql6("o.value")} AS held_value,
          {sql6("o.v[1]")} AS held_0, {sql6("o.v[2]")} AS held_1, {sql6("o.v[3]")} AS held_2
        FROM w ASOF LEFT JOIN o ON w.source_id = o.source_id AND w.channel_id = o.channel_id AND w.kind = o.kind AND w.t_ns >= o.ts_ns""",
    ),
    "r6_asof_vectors": Query(
        r6_vectors,
        f"""WITH {TEL}, {VECTORS}, o AS (SELECT source_id, ts_ns, max(seq) AS seq, arg_max(value, seq) AS value FROM vec GROUP BY ALL)
        SELECT c.source_id, c.ts_ns, c.seq AS click_seq, o.ts_ns AS vector_ts_ns, o.seq AS vec_id, {sql6("o.value[1]")} AS v0, {sql6("o.value[2]")} AS v1, {sql6("o.value[3]")} AS v2
        FROM (SELECT * FROM tel WHERE channel_id = 'click') c ASOF LEFT JOIN o ON c.source_id = o.source_id AND c.ts_ns >= o.ts_ns""",
    ),
    "r6_asof_join": Query(
        r6_asof,
        f"""WITH {TEL}, e AS (SELECT source_id, ts_ns, max_by(seq, seq) AS seq, max_by(value, seq) AS value FROM tel WHERE channel_id = 'error' GROUP BY ALL)
        SELECT c.source_id, c.ts_ns, c.seq AS click_seq, e.ts_ns AS error_ts_ns, e.seq AS error_seq, {sql6("e.value")} AS error_value
        FROM (SELECT * FROM tel WHERE channel_id = 'click') c ASOF LEFT JOIN e ON c.source_id = e.source_id AND c.ts_ns >= e.ts_ns""",
    ),
    "r6_asof_tolerance": Query(
        r6_tolerance,
        f"""WITH {TEL}, e AS (SELECT source_id, ts_ns, max(seq) AS seq FROM tel WHERE channel_id = 'signup' GROUP BY ALL)
        SELECT c.source_id, c.ts_ns, c.seq AS trigger_seq,
               CASE WHEN c.ts_ns - e.ts_ns <= {HOUR} THEN e.ts_ns END AS match_ts_ns,
               CASE WHEN c.ts_ns - e.ts_ns <= {HOUR} THEN e.seq END AS match_seq
        FROM tel c ASOF LEFT JOIN e ON c.source_id = e.source_id AND c.ts_ns >= e.ts_ns""",
    ),
    "r7_offset_range": Query(
        r7,
        f"""WITH {TEL}, {SOURCES} SELECT source_id, channel_id, ts_ns + shift AS ts_ns, seq, {VALUE} AS value
        FROM tel JOIN src USING (source_id) WHERE ts_ns + shift >= {START} AND ts_ns + shift < {END}""",
    ),
    "r7_apply_offsets": Query(
        r7_apply,
        f"""WITH {TEL}, {SOURCES} SELECT source_id, channel_id, min(ts_ns + shift) AS first_ns, max(ts_ns + shift) AS last_ns, sum(seq)::BIGINT AS seq_sum
        FROM tel JOIN src USING (source_id) GROUP BY source_id, channel_id""",
    ),
    "r8_keyframe_at": Query(
        r8,
        f"""WITH {TEL}, {FRAMES} SELECT channel_id, coalesce(max(decode_idx) FILTER (pts_ns <= {T0 + 55_555_555_555}), -1) AS frame_idx,
        coalesce(max(decode_idx) FILTER (is_key AND pts_ns <= {T0 + 55_555_555_555}), min(decode_idx) FILTER (is_key), -1) AS key_idx
        FROM fr GROUP BY channel_id""",
    ),
    "r9_frames_from": Query(
        r9,
        f"""WITH {TEL}, {FRAMES}, k AS (SELECT channel_id, coalesce(max(pts_ns) FILTER (is_key AND pts_ns <= {T0 + 55_555_555_555}), min(pts_ns) FILTER (is_key)) AS s
        FROM fr GROUP BY channel_id) SELECT fr.* FROM fr JOIN k USING (channel_id) WHERE pts_ns >= s""",
    ),
    "r11_slice_events": Query(
        r11,
        f"""WITH {TEL} SELECT e.seq AS event_no, e.source_id, c.ts_ns, c.seq, {sql6("c.value")} AS value
        FROM tel e JOIN tel c ON e.channel_id = 'error' AND c.channel_id = 'click' AND e.source_id = c.source_id
        AND c.ts_ns BETWEEN e.ts_ns - (e.seq % 5) * {HOUR} AND e.ts_ns + (e.seq % 3) * {HOUR}""",
    ),
    "r12_time_merge": Query(r12, f"WITH {TEL} SELECT {COLS} FROM tel ORDER BY ts_ns, seq"),
    "r13_coverage_ranges": Query(
        r13,
        f"""WITH {TEL}, {FRAMES}, b AS (SELECT *, decode_idx - row_number() OVER (PARTITION BY channel_id ORDER BY decode_idx) AS run FROM fr)
        SELECT channel_id, min(decode_idx) AS first_idx, max(decode_idx) AS last_idx, min(pts_ns) AS start_ns, max(pts_ns) + 1 AS end_ns FROM b GROUP BY channel_id, run""",
    ),
    "r14_coalesce_intervals": Query(
        r14,
        f"""WITH {TEL}, {WINDOWS}, c AS (SELECT source_id, greatest(start_ns, {T0 + DAY}) AS s, 'w' || lpad(window_id::VARCHAR, 9, '0') AS kind,
          least(end_ns, {T0 + 25 * DAY}) AS e FROM win),
        d AS (SELECT * FROM c WHERE e > s),
        m AS (SELECT *, max(e) OVER (PARTITION BY source_id ORDER BY s, e, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d),
        i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY s, e, kind ROWS UNBOUNDED PRECEDING) AS isl FROM m)
        SELECT source_id, min(s) AS start_ns, max(e) AS end_ns, arg_min(kind, {{'s': s, 'e': e, 'k': kind}}) AS kind FROM i GROUP BY source_id, isl""",
    ),
}

# The same join with the hot-series plan forced by a small split target.
QUERIES["r6_asof_join_hot"] = Query(partial(r6_asof, target=TARGET // 4), QUERIES["r6_asof_join"].sql)
QUERIES["r6_asof_vectors_hot"] = Query(partial(r6_vectors, target=TARGET // 8), QUERIES["r6_asof_vectors"].sql)
QUERIES["r5_snapshot_many_hot"] = Query(partial(r5_many, target=TARGET // 8), QUERIES["r5_snapshot_many"].sql)
# From a stored lake, whose histogram tells where the last sample of a series is.
QUERIES["r2_fetch_range_prev_lake"] = Query(r2_lake, QUERIES["r2_fetch_range_prev"].sql)
QUERIES["r4_sample_at_lake"] = Query(r4_lake, QUERIES["r4_sample_at"].sql)
