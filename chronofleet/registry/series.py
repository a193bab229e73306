"""Transform, alignment, segment and summary queries."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import functions as F

from chronofleet.operators import frames as fr
from chronofleet.operators import series as se
from chronofleet.registry.common import CHANNELS, DAY, FINITE, T0, TARGET, TEL, Query, rounded, sql6, table, telemetry

END = T0 + 31 * DAY
HOLD = 3_600_000_000_000
COLS = "source_id, channel_id, ts_ns, seq"
ORDER = "PARTITION BY source_id, channel_id ORDER BY ts_ns, seq"
PI = math.pi
PI2 = 2 * math.pi


def _spec(spark):
    rows = [("click", "abs", None, None), ("error", "scale", 2.5, -3.0), ("purchase", "derivative", None, None), ("view", "none", None, None)]
    return spark.createDataFrame(rows, "channel_id string, kind string, mul double, add double")


def d1(spark, sf_dir):
    return rounded(se.transform(telemetry(spark, sf_dir), _spec(spark)), "value").select("source_id", "channel_id", "ts_ns", "seq", "value")


def d1_abs_scale(spark, sf_dir):
    t = se.scale(se.absolute(telemetry(spark, sf_dir)), -1.5, 10.0)
    return rounded(t, "value")


def d2(spark, sf_dir):
    return rounded(se.derivative(telemetry(spark, sf_dir)), "value")


def d2_by_source(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return rounded(se.derivative(t, ["source_id"], target_rows=TARGET), "value")


def _angles(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    angle = F.when(F.col("seq") % 97 == 0, 0.0).when(F.col("seq") % 101 == 0, 1.0).otherwise(F.col("value") % 6.0)
    return t.withColumn("value", angle - 3.0)


ANGLES = "ang AS (SELECT source_id, channel_id, ts_ns, seq, (CASE WHEN seq % 97 = 0 THEN 0.0 WHEN seq % 101 = 0 THEN 1.0 ELSE value % 6.0 END)::DOUBLE - 3.0 AS value FROM tel)"


def d3(spark, sf_dir):
    return rounded(se.gradient(_angles(spark, sf_dir)), "value")


def d4(spark, sf_dir, target=None):
    return rounded(se.unwrap(_angles(spark, sf_dir), target_rows=target), "value")


def _poses(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    half = F.col("value") / 100.0
    return e.select(
        F.concat(F.lit("log-"), (F.col("user_id") % 4).cast("string")).alias("source_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"), F.col("event_id").alias("seq"),
        (F.col("value") * 10.0).alias("x"), (F.col("event_id") % 100).cast("double").alias("y"),
        F.cos(half).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"),
    )


def d5(spark, sf_dir):
    out = se.ego_signals(_poses(spark, sf_dir))
    return rounded(out.select("source_id", "ts_ns", "seq", "speed", "yaw_rate_dps", "accel"), "speed", "yaw_rate_dps", "accel")


def _grad(v: str, part: str) -> str:
    w = f"OVER ({part})"
    p, n = f"lag({v}) {w}", f"lead({v}) {w}"
    hs = f"((ts_ns - lag(ts_ns) {w}) / 1e9)"
    hd = f"((lead(ts_ns) {w} - ts_ns) / 1e9)"
    return f"""CASE WHEN lag(ts_ns) {w} IS NULL AND lead(ts_ns) {w} IS NULL THEN NULL
      WHEN lag(ts_ns) {w} IS NULL THEN ({n} - {v}) / nullif({hd}, 0)
      WHEN lead(ts_ns) {w} IS NULL THEN ({v} - {p}) / nullif({hs}, 0)
      ELSE ({hs}*{hs}*{n} + ({hd}*{hd} - {hs}*{hs})*{v} - {hd}*{hd}*{p}) / nullif({hs}*{hd}*({hd}+{hs}), 0) END"""


SRC = "PARTITION BY source_id ORDER BY ts_ns, seq"
WRAP = """u1 AS (SELECT *, {v} - lag({v}) OVER ({part}) AS step FROM {t}),
  u2 AS (SELECT *, ((step + {pi}) - floor((step + {pi}) / {pi2}) * {pi2}) - {pi} AS m FROM u1),
  u3 AS (SELECT *, CASE WHEN step IS NULL OR abs(step) < {pi} THEN 0 ELSE round((CASE WHEN m = -{pi} AND step > 0 THEN {pi} ELSE m END - step) / {pi2}) END AS k FROM u2),
  uw AS (SELECT *, {v} + sum(k) OVER ({part} ROWS UNBOUNDED PRECEDING) * {pi2} AS unwrapped FROM u3)"""


def _wrap(t: str, v: str, part: str) -> str:
    return WRAP.format(t=t, v=v, part=part, pi=repr(PI), pi2=repr(PI2))


def d6(spark, sf_dir, target=None):
    return rounded(se.align_union(telemetry(spark, sf_dir), CHANNELS, target_rows=target), *CHANNELS)


def d7(spark, sf_dir, target=None):
    return rounded(se.align_hold(telemetry(spark, sf_dir), CHANNELS, HOLD, target_rows=target), *CHANNELS)


def d8(spark, sf_dir, target=None):
    return rounded(se.table_model(telemetry(spark, sf_dir), CHANNELS, target_rows=target), *CHANNELS)


def d9(spark, sf_dir):
    return rounded(se.series_stats(telemetry(spark, sf_dir)), "min_value", "max_value", "mean_value")


def d10(spark, sf_dir, target=None):
    t = telemetry(spark, sf_dir)
    out = se.zip_by_index(t.filter(F.col("channel_id") == "click"), t.filter(F.col("channel_id") == "view"), target_rows=target)
    return rounded(out.select("source_id", "idx", "ts_ns", "a", "b"), "a", "b")


def d11(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    lat = t.filter(F.col("channel_id") == "click").withColumn("value", F.col("value") / 10.0)
    lon = t.filter(F.col("channel_id") == "view").withColumn("value", F.col("value") / 5.0)
    return rounded(se.gps_track(lat, lon, max_points=100), "lat", "lon")


def _states(spark, sf_dir):
    level = F.when(F.col("seq") % 97 == 0, F.col("value")).when(F.col("seq") % 101 == 0, F.col("value")).otherwise(F.floor(F.col("value") / 50.0).cast("double"))
    return telemetry(spark, sf_dir).withColumn("value", level)


STATES = """st AS (SELECT source_id, channel_id, ts_ns, seq, CASE WHEN seq % 97 = 0 OR seq % 101 = 0 THEN NULL ELSE floor(value / 50.0) END AS state FROM tel)"""
SEGMENTS = f"""{STATES},
  c AS (SELECT *, lag(state) OVER w AS p, row_number() OVER w AS rn FROM st WINDOW w AS ({ORDER})),
  ch AS (SELECT * FROM c WHERE rn = 1 OR state IS DISTINCT FROM p),
  seg AS (SELECT source_id, channel_id, ts_ns AS start_ns, coalesce(lead(ts_ns) OVER ({ORDER}), {END}) AS end_ns, state AS value FROM ch)"""


def d12(spark, sf_dir, target=None):
    return se.state_segments(_states(spark, sf_dir), END, target_rows=target)


def d13(spark, sf_dir):
    return se.state_at(se.state_segments(_states(spark, sf_dir), END), T0 + 15 * DAY)


def d14(spark, sf_dir):
    out = se.compare_sources(se.series_stats(telemetry(spark, sf_dir)), "log-0", "log-1")
    return rounded(out, "left_min_value", "left_max_value", "right_min_value", "right_max_value")


def _trace(spark, sf_dir):
    """Paints per user: wall time from the event time, source time from the event number."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("wall_ns"),
        (F.col("event_id") * 33_333_333 - F.when(F.col("event_id") % 41 == 0, 4_000_000_000).otherwise(0)).alias("pts_ns"), F.col("event_id").alias("seq"),
    )


PACING = (
    "ideal_dwell_ms", "p50_dwell_ms", "p95_dwell_ms", "max_dwell_ms", "min_dwell_ms", "mean_dwell_ms", "jitter_ms",
    "playback_rate_ratio", "first_half_rate", "second_half_rate", "source_jitter_ms", "player_err_std_ms",
    "player_err_max_ms", "player_err_std_regular_ms", "player_err_p95_ms",
)
# Sums of squares of large dwells differ in the last digits between engines.
_PLACES = {"jitter_ms": 1, "source_jitter_ms": 1, "player_err_std_ms": 1, "player_err_std_regular_ms": 1}


def d15(spark, sf_dir):
    out = fr.pacing_summary(_trace(spark, sf_dir), ["user_id"], 2.0)
    out = out.withColumns({c: F.round(c, _PLACES.get(c, 3)) for c in PACING})
    return out.withColumns({f"hist_{i}": F.get("hist_dwell", F.lit(i)) for i in range(7)}).drop("hist_dwell")


def d15_rolling(spark, sf_dir):
    trace = _trace(spark, sf_dir).withColumn("grp", F.col("user_id") % 4).drop("user_id")
    return fr.rolling_trace(trace, ["grp"], 600)


def d16(spark, sf_dir):
    ticks = _trace(spark, sf_dir).select(F.col("user_id"), "wall_ns", "seq")
    return rounded(fr.tick_health(ticks, ["user_id"]), "tick_gap_max_ms", "tick_gap_p95_ms")


def _at(col: str, p: str) -> str:
    return f"list_sort(list({col}))[least(count(*), floor(count(*) * {p})::BIGINT + 1)]"


def _fin(c: str) -> str:
    return FINITE.format(c)


def _align_cells() -> str:
    return ", ".join(f"max(CASE WHEN channel_id = '{c}' THEN {_fin('value')} END) AS {c}" for c in CHANNELS)


def _held(c: str) -> str:
    return f"""h_{c} AS (SELECT a.source_id, a.ts_ns, s.ts_ns AS s_ts, s.value, a.ts_ns = s.ts_ns AS exact FROM axis a
      ASOF LEFT JOIN (SELECT * FROM once WHERE channel_id = '{c}') s ON a.source_id = s.source_id AND a.ts_ns >= s.ts_ns)"""


ONCE = "once AS (SELECT source_id, channel_id, ts_ns, max_by(value, seq) AS value FROM t3 GROUP BY ALL)"
T3 = "t3 AS (SELECT * FROM tel WHERE channel_id IN ('click', 'error', 'purchase', 'signup', 'view'))"
HELD = ", ".join(_held(c) for c in CHANNELS)
JOINED = "axis a " + " ".join(f"JOIN h_{c} ON h_{c}.source_id = a.source_id AND h_{c}.ts_ns = a.ts_ns" for c in CHANNELS)
EPS = max(1, round(HOLD * 1e-6))

QUERIES = {
    "d1_transform": Query(
        d1,
        f"""WITH {TEL} SELECT {COLS}, {sql6(f'''CASE channel_id WHEN 'click' THEN abs(value) WHEN 'error' THEN value * 2.5 - 3.0
        WHEN 'purchase' THEN CASE WHEN ts_ns > lag(ts_ns) OVER ({ORDER}) THEN (value - lag(value) OVER ({ORDER})) / ((ts_ns - lag(ts_ns) OVER ({ORDER})) / 1e9) END
        ELSE value END''')} AS value FROM tel""",
    ),
    "d1_abs_scale": Query(d1_abs_scale, f"WITH {TEL} SELECT {COLS}, {sql6('abs(value) * -1.5 + 10.0')} AS value FROM tel"),
    "d2_derivative": Query(
        d2,
        f"""WITH {TEL} SELECT {COLS}, {sql6(f'''CASE WHEN ts_ns > lag(ts_ns) OVER ({ORDER})
        THEN (value - lag(value) OVER ({ORDER})) / ((ts_ns - lag(ts_ns) OVER ({ORDER})) / 1e9) END''')} AS value FROM tel""",
    ),
    "d2_derivative_hot": Query(
        d2_by_source,
        f"""WITH {TEL} SELECT {COLS}, {sql6(f'''CASE WHEN ts_ns > lag(ts_ns) OVER ({SRC})
        THEN (value - lag(value) OVER ({SRC})) / ((ts_ns - lag(ts_ns) OVER ({SRC})) / 1e9) END''')} AS value FROM tel""",
    ),
    "d3_gradient": Query(d3, f"WITH {TEL}, {ANGLES} SELECT {COLS}, {sql6(_grad('value', ORDER))} AS value FROM ang"),
    "d4_unwrap": Query(d4, f"WITH {TEL}, {ANGLES}, {_wrap('ang', 'value', ORDER)} SELECT {COLS}, {sql6('unwrapped')} AS value FROM uw"),
    "d5_ego_signals": Query(
        d5,
        f"""WITH p AS (SELECT 'log-' || (user_id % 4) AS source_id, epoch_us(ts) * 1000 AS ts_ns, event_id AS seq, value * 10.0 AS x,
            (event_id % 100)::DOUBLE AS y, cos(value / 100.0) AS qw, sin(value / 100.0) AS qz FROM events),
        q AS (SELECT *, atan2(2 * (qw * qz), 1 - 2 * (qz * qz)) AS yaw FROM p),
        v AS (SELECT source_id, ts_ns, seq, {_grad('x', SRC)} AS vx, {_grad('y', SRC)} AS vy FROM q),
        s AS (SELECT source_id, ts_ns, seq, sqrt(vx * vx + vy * vy) AS speed FROM v),
        {_wrap('q', 'yaw', SRC)},
        r AS (SELECT source_id, ts_ns, seq, degrees({_grad('unwrapped', SRC)}) AS rate FROM uw),
        a AS (SELECT source_id, ts_ns, seq, speed, {_grad('speed', SRC)} AS accel FROM s)
        SELECT a.source_id, a.ts_ns, a.seq, {sql6('speed')} AS speed, {sql6('rate')} AS yaw_rate_dps, {sql6('accel')} AS accel
        FROM a JOIN r USING (source_id, ts_ns, seq)""",
    ),
    "d6_align_union": Query(
        d6,
        f"""WITH {TEL}, o AS (SELECT *, row_number() OVER (PARTITION BY source_id, channel_id, ts_ns ORDER BY seq) - 1 AS occurrence FROM tel
        WHERE channel_id IN ('click', 'error', 'purchase', 'signup', 'view')),
        g AS (SELECT source_id, ts_ns, occurrence, {_align_cells()} FROM o GROUP BY source_id, ts_ns, occurrence)
        SELECT source_id, ts_ns, occurrence, {', '.join(f'{sql6(c)} AS {c}' for c in CHANNELS)} FROM g""",
    ),
    "d7_align_hold": Query(
        d7,
        f"""WITH {TEL}, {T3}, {ONCE},
        gaps AS (SELECT *, lead(ts_ns) OVER (PARTITION BY source_id, channel_id ORDER BY ts_ns) AS nx FROM once),
        axis AS (SELECT source_id, ts_ns FROM once UNION SELECT source_id, ts_ns + {HOLD} FROM gaps WHERE nx - ts_ns > {HOLD}
                 UNION SELECT source_id, ts_ns + {HOLD} + {EPS} FROM gaps WHERE nx - ts_ns > {HOLD}), {HELD}
        SELECT a.source_id, a.ts_ns, {', '.join(sql6(f'CASE WHEN a.ts_ns - h_{c}.s_ts <= {HOLD} THEN h_{c}.value END') + f' AS {c}' for c in CHANNELS)} FROM {JOINED}""",
    ),
    "d8_table_model": Query(
        d8,
        f"""WITH {TEL}, {T3}, {ONCE}, axis AS (SELECT DISTINCT source_id, ts_ns FROM once), {HELD}
        SELECT a.source_id, a.ts_ns, {', '.join(sql6(f'h_{c}.value') + f' AS {c}, coalesce(h_{c}.exact, false) AS {c}__exact' for c in CHANNELS)},
        false AS truncated FROM {JOINED}""",
    ),
    "d9_series_stats": Query(
        d9,
        f"""WITH {TEL}, f AS (SELECT *, {_fin('value')} AS v FROM tel) SELECT source_id, channel_id, {sql6('min(v)')} AS min_value,
        {sql6('max(v)')} AS max_value, {sql6('avg(v)')} AS mean_value, count(*) AS sample_count FROM f GROUP BY source_id, channel_id""",
    ),
    "d10_zip_by_index": Query(
        d10,
        f"""WITH {TEL}, i AS (SELECT *, row_number() OVER ({ORDER}) - 1 AS idx FROM tel)
        SELECT a.source_id, a.idx, a.ts_ns, {sql6('a.value')} AS a, {sql6('b.value')} AS b FROM i a JOIN i b
        ON a.channel_id = 'click' AND b.channel_id = 'view' AND a.source_id = b.source_id AND a.idx = b.idx""",
    ),
    "d11_gps_track": Query(
        d11,
        f"""WITH {TEL}, i AS (SELECT *, row_number() OVER ({ORDER}) - 1 AS idx FROM tel),
        z AS (SELECT a.source_id, a.idx, a.ts_ns, a.value / 10.0 AS lat, b.value / 5.0 AS lon FROM i a JOIN i b
              ON a.channel_id = 'click' AND b.channel_id = 'view' AND a.source_id = b.source_id AND a.idx = b.idx),
        n AS (SELECT source_id, count(*) AS n, greatest(1, ceil(count(*) / 100.0))::BIGINT AS stride FROM z GROUP BY source_id),
        k AS (SELECT z.*, n, stride, isfinite(lat) AND isfinite(lon) AS ok FROM z JOIN n USING (source_id)),
        kept AS (SELECT * FROM k WHERE ok AND idx % stride = 0),
        l AS (SELECT source_id, arg_max(lat, idx) AS lat, arg_max(lon, idx) AS lon FROM kept GROUP BY source_id),
        tail AS (SELECT k.* FROM k LEFT JOIN l USING (source_id) WHERE ok AND idx = n - 1 AND idx % stride <> 0
                 AND (l.lat IS NULL OR l.lat <> k.lat OR l.lon <> k.lon)),
        u AS (SELECT * FROM kept UNION ALL SELECT * FROM tail)
        SELECT source_id, idx, ts_ns, {sql6('lat')} AS lat, {sql6('lon')} AS lon FROM u""",
    ),
    "d12_state_segments": Query(d12, f"WITH {TEL}, {SEGMENTS} SELECT * FROM seg"),
    "d13_state_at": Query(
        d13,
        f"""WITH {TEL}, {SEGMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id, channel_id ORDER BY start_ns DESC, end_ns DESC) AS rn
        FROM seg WHERE start_ns <= {T0 + 15 * DAY}) SELECT source_id, channel_id, start_ns, end_ns, value FROM r WHERE rn = 1""",
    ),
    "d14_compare_sources": Query(
        d14,
        f"""WITH {TEL}, f AS (SELECT *, {_fin('value')} AS v FROM tel),
        s AS (SELECT source_id, channel_id, min(v) AS mn, max(v) AS mx, count(*) AS n FROM f GROUP BY source_id, channel_id)
        SELECT a.channel_id, {sql6('a.mn')} AS left_min_value, {sql6('a.mx')} AS left_max_value, a.n AS left_sample_count,
        {sql6('b.mn')} AS right_min_value, {sql6('b.mx')} AS right_max_value, b.n AS right_sample_count,
        abs(a.mn - b.mn) <= 1e-9 AND abs(a.mx - b.mx) <= 1e-9 AND a.n = b.n AS agrees
        FROM s a JOIN s b ON a.source_id = 'log-0' AND b.source_id = 'log-1' AND a.channel_id = b.channel_id""",
    ),
    "d15_pacing_summary": Query(
        d15,
        f"""WITH tr AS (SELECT user_id, epoch_us(ts) * 1000 AS wall_ns, event_id * 33333333 - CASE WHEN event_id % 41 = 0 THEN 4000000000 ELSE 0 END AS pts_ns, event_id AS seq FROM events),
        l AS (SELECT *, lag(wall_ns) OVER w AS pw, lag(pts_ns) OVER w AS pp, row_number() OVER w - 2 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM tr WINDOW w AS (PARTITION BY user_id ORDER BY wall_ns, seq)),
        p AS (SELECT user_id, i, n, (wall_ns - pw) / 1e6 AS d, wall_ns - pw AS dn, pts_ns - pp AS step, (pts_ns - pp) / 1e6 / 2.0 AS want FROM l WHERE pw IS NOT NULL),
        e AS (SELECT *, d - want AS err FROM p),
        b AS (SELECT user_id, abs({_at('step', '0.5')}) AS si, abs({_at('step', '0.5')}) / 2.0 / 1e6 AS ideal FROM e WHERE n >= 3 GROUP BY user_id),
        j AS (SELECT e.*, si, ideal, d / ideal AS r FROM e JOIN b USING (user_id)),
        s AS (SELECT user_id, any_value(si) AS source_interval_ns, any_value(ideal) AS ideal,
          {_at('d', '0.5')} AS p50, {_at('d', '0.95')} AS p95, max(d) AS mx, min(d) AS mn, avg(dn) / 1e6 AS mean, stddev_pop(d) AS jit,
          count(*) FILTER (d >= 1.5 * ideal) AS repeats, count(*) FILTER (d <= 0.5 * ideal AND NOT d >= 1.5 * ideal) AS rushed,
          count(*) FILTER (step < 0) AS backward_steps, avg(dn) FILTER (i < floor((n - 1) / 2)) / 1e6 AS f1, avg(dn) FILTER (i >= floor((n - 1) / 2)) / 1e6 AS f2,
          stddev_pop(want) AS sj, stddev_pop(err) AS es, max(abs(err)) AS em, {_at('abs(err)', '0.95')} AS ep,
          coalesce(stddev_pop(err) FILTER (want BETWEEN 0.75 * ideal AND 1.25 * ideal), 0) AS er,
          count(*) FILTER (want BETWEEN 0.75 * ideal AND 1.25 * ideal) AS regular_pairs,
          count(*) FILTER (r < 0.25) AS h0, count(*) FILTER (r >= 0.25 AND r < 0.5) AS h1, count(*) FILTER (r >= 0.5 AND r < 0.75) AS h2,
          count(*) FILTER (r >= 0.75 AND r < 1.25) AS h3, count(*) FILTER (r >= 1.25 AND r < 1.75) AS h4, count(*) FILTER (r >= 1.75 AND r < 2.5) AS h5, count(*) FILTER (r >= 2.5) AS h6
          FROM j GROUP BY user_id),
        c AS (SELECT user_id, count(*) AS paints FROM tr GROUP BY user_id)
        SELECT user_id, paints, coalesce(source_interval_ns, 0) AS source_interval_ns, round(coalesce(ideal, 0), 3) AS ideal_dwell_ms,
          round(coalesce(p50, 0), 3) AS p50_dwell_ms, round(coalesce(p95, 0), 3) AS p95_dwell_ms, round(coalesce(mx, 0), 3) AS max_dwell_ms,
          round(coalesce(mn, 0), 3) AS min_dwell_ms, round(coalesce(mean, 0), 3) AS mean_dwell_ms, round(coalesce(jit, 0), 1) AS jitter_ms,
          coalesce(repeats, 0) AS repeats, coalesce(rushed, 0) AS rushed, coalesce(backward_steps, 0) AS backward_steps,
          round(coalesce(CASE WHEN mean > 0 THEN ideal / mean END, 0), 3) AS playback_rate_ratio,
          round(coalesce(CASE WHEN f1 > 0 THEN ideal / f1 END, 0), 3) AS first_half_rate, round(coalesce(CASE WHEN f2 > 0 THEN ideal / f2 END, 0), 3) AS second_half_rate,
          round(coalesce(sj, 0), 1) AS source_jitter_ms, round(coalesce(es, 0), 1) AS player_err_std_ms, round(coalesce(em, 0), 3) AS player_err_max_ms,
          round(coalesce(er, 0), 1) AS player_err_std_regular_ms, coalesce(regular_pairs, 0) AS regular_pairs, round(coalesce(ep, 0), 3) AS player_err_p95_ms,
          coalesce(ideal > 0 AND backward_steps = 0 AND jit <= 0.25 * ideal AND p95 <= 1.5 * ideal AND repeats <= 0.05 * (paints - 1)
            AND ideal / mean BETWEEN 0.9 AND 1.1, false) AS smooth,
          coalesce(h0, 0) AS hist_0, coalesce(h1, 0) AS hist_1, coalesce(h2, 0) AS hist_2, coalesce(h3, 0) AS hist_3, coalesce(h4, 0) AS hist_4, coalesce(h5, 0) AS hist_5, coalesce(h6, 0) AS hist_6
        FROM c LEFT JOIN s USING (user_id)""",
    ),
    "d15_rolling_window": Query(
        d15_rolling,
        """WITH r AS (SELECT user_id % 4 AS grp, epoch_us(ts) * 1000 AS wall_ns, event_id * 33333333 - CASE WHEN event_id % 41 = 0 THEN 4000000000 ELSE 0 END AS pts_ns, event_id AS seq,
        row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT grp, wall_ns, pts_ns, seq FROM r WHERE rn <= 600""",
    ),
    "d16_tick_health": Query(
        d16,
        f"""WITH l AS (SELECT user_id, (epoch_us(ts) * 1000 - lag(epoch_us(ts) * 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events)
        SELECT user_id, count(*) AS ticks, {sql6('max(gap)')} AS tick_gap_max_ms, count(*) FILTER (gap > 12) AS starved_ticks, {sql6(_at('gap', '0.95'))} AS tick_gap_p95_ms
        FROM l WHERE gap IS NOT NULL GROUP BY user_id""",
    ),
}

# The same operators with the hot-series plan forced by a small split target.
for _name in ("d4_unwrap", "d6_align_union", "d7_align_hold", "d8_table_model", "d10_zip_by_index", "d12_state_segments"):
    QUERIES[f"{_name}_hot"] = Query(partial(QUERIES[_name].run, target=TARGET // 4), QUERIES[_name].sql)
