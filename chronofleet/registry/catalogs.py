"""Catalog, naming, unit and grouping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofleet.operators import catalog as ct
from chronofleet.registry.common import T0, TEL, Query, spins, table, telemetry
from chronofleet.sources.sinks import catalog_json

UNITS = [("click", "m/s"), ("error", " "), ("purchase", "deg")]


def c1(spark, sf_dir):
    units = spark.createDataFrame(UNITS, "channel_id string, unit string")
    return ct.channel_catalog(telemetry(spark, sf_dir), units=units)


def c2(spark, sf_dir):
    return ct.frame_catalog(spins(spark, sf_dir), F.size("intensities"))


def c2_times(spark, sf_dir):
    return ct.frame_times(spins(spark, sf_dir))


def c3(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    kind = F.when(F.col("source_id") == "log-3", "calibration").otherwise("tabular")
    s = t.groupBy("source_id").agg(F.min("ts_ns").alias("start_ns"), (F.max("ts_ns") + 1).alias("end_ns")).withColumn("kind", kind)
    return ct.global_range(s)


def c4(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    name = F.col("p_name")
    ids = t.select(ct.qualify_id(name, F.col("p_brand")).alias("qualified"))
    return ids.groupBy("qualified").agg(F.count(F.lit(1)).alias("n"))


def c4_sources(spark, sf_dir):
    """Every tenth part is named as if it were a numbered duplicate already."""
    t = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 10 == 0, F.concat("p_name", F.lit(" ("), (F.col("p_partkey") % 7 + 2).cast("string"), F.lit(")")))
    named = t.select(F.coalesce(name, F.col("p_name")).alias("name"), F.col("p_partkey").alias("ord"))
    out = ct.dedupe_source_ids(named)
    return out.agg(F.count(F.lit(1)).alias("n_sources"), F.countDistinct("source_id").alias("n_ids"), F.count_if(F.col("source_id") == F.col("name")).alias("n_kept"))


def _files(spark, sf_dir):
    """Channels of measurement files: part name and size as channel name and group."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("source_id"), F.col("p_name").alias("name"), (F.col("p_size") % 7).alias("g"), F.col("p_partkey").alias("c"))


def c5(spark, sf_dir):
    return ct.disambiguate_names(_files(spark, sf_dir))


def c6(spark, sf_dir):
    return ct.infer_period(telemetry(spark, sf_dir), 1_000_000)


def _channels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    topic = F.concat(F.lit("/"), F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")))
    return p.select(
        F.lit("fleet").alias("source_id"), F.col("p_partkey").cast("string").alias("channel_id"), topic.alias("name"),
        F.when(F.col("p_size") % 5 == 0, F.col("p_brand")).alias("group"), F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("u"), F.col("p_size").cast("string"))).alias("unit"),
    )


CHANNELS = """ch AS (SELECT p_partkey::VARCHAR AS channel_id, '/' || lower(p_type) || '/' || replace(p_name, ' ', '/') AS name,
  CASE WHEN p_size % 5 = 0 THEN p_brand END AS grp, CASE WHEN p_size % 3 > 0 THEN 'u' || p_size END AS unit, p_partkey FROM part)"""
PATH = """pa AS (SELECT channel_id, list_concat(CASE WHEN grp IS NULL THEN [] ELSE [grp] END, list_filter(string_split(name, '/'), lambda s: s <> '')) AS path FROM ch)"""


def c7(spark, sf_dir):
    ch = _channels(spark, sf_dir)
    over = ch.filter(F.col("channel_id").cast("int") % 4 == 0).select(
        "channel_id", F.when(F.col("channel_id").cast("int") % 8 == 0, F.lit("  ")).otherwise(F.lit(" km ")).alias("unit")
    )
    return ct.effective_units(ch, over).select("channel_id", "effective_unit", "label")


def c8(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    name = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).when(F.col("n_nationkey") % 3 == 1, F.lit(" "))
    comment = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("c "), "n_name"))
    return n.select("n_nationkey", ct.group_label(name, comment, F.col("n_nationkey")).alias("label"))


def c9(spark, sf_dir):
    return ct.search_channels(_channels(spark, sf_dir), " BoL ").select("channel_id", "name")


def c10(spark, sf_dir):
    return ct.channel_tree(_channels(spark, sf_dir))


def _grouped(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name = F.when(k % 97 == 0, "gps/latitude").when(k % 89 == 0, "gps/lng").otherwise(F.concat(F.lower("p_type"), F.lit("/"), "p_name"))
    ch = p.select(F.col("p_brand").alias("source_id"), k.cast("string").alias("channel_id"), name.alias("name"), F.when(F.col("p_size") % 9 == 0, "enum").otherwise("scalar").alias("kind"), k.alias("ord"))
    stats = p.select(F.col("p_brand").alias("source_id"), k.cast("string").alias("channel_id"), (-F.col("p_size") * 2.0).alias("min_value"), (F.col("p_size") * 2.0).alias("max_value"))
    return ct.group_channels(ch, stats)


def c12(spark, sf_dir):
    """Videos named after customers of a nation, cameras after the nation's suppliers."""
    cust = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("source_id"), F.col("c_custkey").alias("video_id"), F.concat(F.lit("cam"), (F.col("c_custkey") % 40).cast("string"), F.lit("_front.mp4")).alias("name"))
    cams = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("source_id"), F.concat(F.lit("CAM"), (F.col("s_suppkey") % 40).cast("string")).alias("name"), F.col("s_suppkey").alias("ord"))
    return ct.match_cameras(cust, cams)


def c12_cloud(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Lidar "), "p_name")).otherwise(F.col("p_name"))
    return ct.pick_cloud(p.select(F.col("p_brand").alias("source_id"), F.col("p_partkey").alias("channel_id"), name.alias("name"), F.col("p_partkey").alias("ord")))


def k4(spark, sf_dir):
    out = catalog_json(ct.channel_catalog(telemetry(spark, sf_dir)))
    return out.select("source_id", "channel_id", "json")


QUERIES = {
    "c1_channel_catalog": Query(
        c1,
        f"""WITH {TEL}, u(channel_id, unit) AS (VALUES ('click', 'm/s'), ('error', ' '), ('purchase', 'deg'))
        SELECT source_id, channel_id, 'scalar' AS kind, 'f64' AS dtype, count(*) AS sample_count, min(ts_ns) AS start_ns, max(ts_ns) + 1 AS end_ns, any_value(unit) AS unit
        FROM tel LEFT JOIN u USING (channel_id) GROUP BY source_id, channel_id""",
    ),
    "c2_frame_catalog": Query(
        c2,
        f"""WITH f AS (SELECT 'log-' || (vec_id % 4) AS source_id, 'lidar-' || label AS channel_id, {T0} + vec_id * 100000000 AS ts_ns FROM embeddings),
        g AS (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY source_id, channel_id ORDER BY ts_ns) AS gap FROM f)
        SELECT source_id, channel_id, 21::BIGINT AS sample_count, count(*) AS frame_count, min(ts_ns) AS start_ns,
        max(ts_ns) + coalesce(list_sort(list(gap) FILTER (gap > 0))[(count(*) FILTER (gap > 0)) // 2 + 1], 100000000) AS end_ns FROM g GROUP BY source_id, channel_id""",
    ),
    "c2_frame_times": Query(
        c2_times,
        f"SELECT 'log-' || (vec_id % 4) AS source_id, 'lidar-' || label AS channel_id, row_number() OVER (PARTITION BY vec_id % 4, label ORDER BY vec_id) - 1 AS frame_idx, {T0} + vec_id * 100000000 AS ts_ns FROM embeddings",
    ),
    "c3_global_range": Query(c3, f"WITH {TEL} SELECT min(ts_ns) AS start_ns, max(ts_ns) + 1 AS end_ns FROM tel WHERE source_id <> 'log-3'"),
    "c4_qualified_ids": Query(c4, "SELECT length(p_name) || '|' || p_name || '|' || p_brand AS qualified, count(*) AS n FROM part GROUP BY 1"),
    "c4_unique_sources": Query(
        c4_sources,
        """WITH n AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN p_name || ' (' || (p_partkey % 7 + 2) || ')' ELSE p_name END AS name FROM part)
        SELECT count(*) AS n_sources, count(*) AS n_ids, count(DISTINCT name) AS n_kept FROM n""",
    ),
    "c5_disambiguate_names": Query(
        c5,
        """WITH f AS (SELECT p_brand AS source_id, p_name AS name, p_size % 7 AS g, p_partkey AS c FROM part),
        k AS (SELECT *, count(*) OVER (PARTITION BY source_id, name) AS n, row_number() OVER (PARTITION BY source_id, name, g ORDER BY c) AS k FROM f)
        SELECT source_id, name, g, c, CASE WHEN n = 1 THEN name WHEN k = 1 THEN name || ' #' || g ELSE name || ' #' || g || '/' || c END AS display_name FROM k""",
    ),
    "c6_infer_period": Query(
        c6,
        f"""WITH {TEL}, g AS (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY source_id, channel_id ORDER BY ts_ns, seq) AS gap FROM tel)
        SELECT source_id, channel_id, coalesce(list_sort(list(gap) FILTER (gap > 0))[(count(*) FILTER (gap > 0)) // 2 + 1], 1000000) AS period_ns FROM g GROUP BY 1, 2""",
    ),
    "c7_effective_units": Query(
        c7,
        f"""WITH {CHANNELS}, e AS (SELECT channel_id, name, CASE WHEN p_partkey % 8 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN 'km' ELSE unit END AS u FROM ch)
        SELECT channel_id, u AS effective_unit, CASE WHEN u IS NULL THEN name ELSE name || ' (' || u || ')' END AS label FROM e""",
    ),
    "c8_group_label": Query(
        c8,
        """SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 2 = 0 THEN 'c ' || n_name ELSE 'Group ' || n_nationkey END AS label FROM nation""",
    ),
    "c9_search_channels": Query(c9, f"WITH {CHANNELS}, {PATH} SELECT channel_id, name FROM ch JOIN pa USING (channel_id) WHERE len(list_filter(path, lambda s: contains(lower(s), 'bol'))) > 0"),
    "c10_channel_tree": Query(
        c10,
        f"""WITH {CHANNELS}, {PATH}, x AS (SELECT channel_id, path, unnest(range(1, len(path) + 1))::INT AS depth FROM pa)
        SELECT array_to_string(path[1:depth], '/') AS key, CASE WHEN depth > 1 THEN array_to_string(path[1:depth - 1], '/') END AS parent,
        path[depth] AS label, depth, count(*) AS leaf_count, bool_or(depth < len(path)) AS is_branch, min(channel_id) FILTER (depth = len(path)) AS channel_id
        FROM x GROUP BY 1, 2, 3, 4""",
    ),
    "c11_group_channels": Query(
        _grouped,
        """WITH c AS (SELECT p_brand AS source_id, p_partkey::VARCHAR AS channel_id, p_partkey AS ord, CASE WHEN p_size % 9 = 0 THEN 'enum' ELSE 'scalar' END AS kind,
          CASE WHEN p_partkey % 97 = 0 THEN 'gps/latitude' WHEN p_partkey % 89 = 0 THEN 'gps/lng' ELSE lower(p_type) || '/' || p_name END AS name, p_size FROM part),
        a AS (SELECT source_id, min(ord) FILTER (name = 'gps/latitude' AND p_size * 2 <= 90.5) AS lat, min(ord) FILTER (name = 'gps/lng' AND p_size * 2 <= 180.5) AS lon FROM c GROUP BY 1),
        p AS (SELECT c.*, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND ord = lat THEN 'map_lat' WHEN lat IS NOT NULL AND lon IS NOT NULL AND ord = lon THEN 'map_lon'
          WHEN kind = 'enum' THEN 'enum' ELSE 'plot' END AS panel FROM c JOIN a USING (source_id)),
        g AS (SELECT *, CASE WHEN panel = 'plot' THEN string_split(name, '/')[1] END AS group_key FROM p)
        SELECT source_id, channel_id, panel, group_key, CASE WHEN panel = 'plot' THEN ceil(row_number() OVER (PARTITION BY source_id, panel, group_key ORDER BY ord) / 16)::INT ELSE 1 END AS part FROM g""",
    ),
    "c12_match_cameras": Query(
        c12,
        """WITH v AS (SELECT c_nationkey::VARCHAR AS source_id, c_custkey AS video_id, 'cam' || (c_custkey % 40) || '_front' AS stem FROM customer),
        k AS (SELECT s_nationkey::VARCHAR AS source_id, 'CAM' || (s_suppkey % 40) AS camera, lower('CAM' || (s_suppkey % 40)) AS l, s_suppkey AS ord FROM supplier),
        j AS (SELECT v.*, camera, CASE WHEN l = stem THEN 1 WHEN contains(stem, l) OR contains(l, stem) THEN 2 ELSE 3 END AS r, ord FROM v JOIN k USING (source_id)),
        o AS (SELECT *, row_number() OVER (PARTITION BY source_id, video_id ORDER BY r, ord) AS rn FROM j) SELECT source_id, video_id, camera FROM o WHERE rn = 1""",
    ),
    "c12_pick_cloud": Query(
        c12_cloud,
        """SELECT p_brand AS source_id, coalesce(min(p_partkey) FILTER (p_size % 4 = 0), min(p_partkey)) AS channel_id FROM part GROUP BY 1""",
    ),
    "k4_catalog_json": Query(
        k4,
        f"""WITH {TEL}, c AS (SELECT source_id, channel_id, count(*) AS n, min(ts_ns) AS s, max(ts_ns) + 1 AS e FROM tel GROUP BY 1, 2)
        SELECT source_id, channel_id, '{{"id":"' || channel_id || '","name":"' || channel_id || '","kind":"scalar","dtype":"f64","unit":null,"sampleCount":' || n ||
        ',"timeRange":{{"startNs":"' || s || '","endNs":"' || e || '"}}}}' AS json FROM c""",
    ),
}
