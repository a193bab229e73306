"""Event import, merge, edit and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofleet.functions.text import url_basename
from chronofleet.functions.time import fmt_absolute, fmt_duration, parse_ns
from chronofleet.operators import events as ev
from chronofleet.registry.common import T0, TEL, Query, rounded, sql6, table, telemetry
from chronofleet.sources.sinks import to_json_columns

SECOND = 1_000_000_000


def _tags():
    i = F.col("seq")
    return F.map_from_arrays(
        F.array(F.lit("weather"), F.concat(F.lit("k"), (i % 4).cast("string"))), F.array(F.concat(F.lit("w"), (i % 3).cast("string")), F.lit("v"))
    )


def events(spark, sf_dir):
    """Errors as stored annotations."""
    t = telemetry(spark, sf_dir).filter(F.col("channel_id") == "error")
    i = F.col("seq")
    return t.select(
        F.concat(F.lit("e"), (i % 5000).cast("string")).alias("id"), i.alias("ord"), F.col("ts_ns").alias("ns"),
        ((i % 5 - 1) * SECOND).alias("before_ns"), ((i % 3) * SECOND).alias("after_ns"),
        F.when(i % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit("label "), i.cast("string"))).alias("label"),
        F.lit("#fff").alias("color"), i.alias("created_at"), _tags().alias("tags"),
        F.when(i % 6 == 0, "agent").otherwise("user").alias("origin"), F.when(i % 2 == 0, i % 7 / 4.0 - 0.25).alias("confidence"),
    )


EV = f"""ev AS (SELECT 'e' || (seq % 5000) AS id, seq AS ord, ts_ns AS ns, (seq % 5 - 1) * {SECOND} AS before_ns, (seq % 3) * {SECOND} AS after_ns,
  CASE WHEN seq % 4 = 0 THEN '  ' ELSE 'label ' || seq END AS label, seq AS i, CASE WHEN seq % 6 = 0 THEN 'agent' ELSE 'user' END AS origin,
  CASE WHEN seq % 2 = 0 THEN seq % 7 / 4.0 - 0.25 END AS confidence FROM tel WHERE channel_id = 'error')"""


def _unique(spark, sf_dir):
    return events(spark, sf_dir).withColumn("id", F.concat(F.lit("e"), F.col("ord").cast("string")))


def _shown(df, *extra):
    keys = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rounded(df.select("id", "ns", "before_ns", "after_ns", "label", keys.alias("tags"), "origin", "confidence", *extra), "confidence")


TAGS = "CASE WHEN {w} THEN '' ELSE 'k' || (i % 4) || '=v,' END || 'weather=w' || (i % 3)"


def _documents(spark, sf_dir):
    """One JSON document per six hours and source of the log, some of them broken."""
    e = _unique(spark, sf_dir)
    doc_no = F.col("ord") % 200
    fields = F.struct(
        F.concat(F.lit("e"), (F.col("ord") % 3000).cast("string")).alias("id"), F.col("ns").cast("string").alias("ns"), F.greatest("before_ns", F.lit(0)).cast("string").alias("beforeNs"),
        F.col("after_ns").alias("afterNs"), F.col("label"), F.col("tags"), F.when(F.col("ord") % 997 == 0, "nobody").otherwise(F.col("origin")).alias("origin"),
        F.when(F.col("confidence").between(0, 1), F.col("confidence")).alias("confidence"),
    )
    lists = e.groupBy(doc_no.alias("d")).agg(F.sort_array(F.collect_list(F.struct("ord", F.to_json(fields).alias("f")))).alias("l"))
    body = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["f"]), ","), F.lit("]"))
    doc = F.when(F.col("d") % 3 == 0, body).otherwise(F.concat(F.lit('{"version":2,"bookmarks":'), body, F.lit("}")))
    return lists.select(F.col("d").cast("string").alias("source_id"), doc.alias("doc"))


DOCS = """dd AS (SELECT *, ord % 200 AS d, 'e' || (ord % 3000) AS raw_id FROM ev),
  bad AS (SELECT DISTINCT d FROM dd WHERE ord % 997 = 0)"""


def e1(spark, sf_dir):
    out, _ = ev.parse_events(_documents(spark, sf_dir))
    return rounded(out.select("source_id", "id", "ns", "before_ns", "after_ns", "label", "origin", "confidence"), "confidence")


def e1_rejected(spark, sf_dir):
    _, bad = ev.parse_events(_documents(spark, sf_dir))
    return bad


def e2(spark, sf_dir):
    v1 = _unique(spark, sf_dir).select("id", "ns", "label", "color", "created_at")
    return _shown(ev.migrate_events(v1))


def _incoming(spark, sf_dir):
    """Clicks renumbered so that some meet a stored event."""
    c = telemetry(spark, sf_dir).filter(F.col("channel_id") == "click")
    i = F.col("seq")
    return c.select(
        F.concat(F.lit("e"), (i + i % 3).cast("string")).alias("id"), i.alias("ord"), F.col("ts_ns").alias("ns"), F.lit(0).cast("bigint").alias("before_ns"),
        F.lit(7).cast("bigint").alias("after_ns"), F.lit("click").alias("label"), F.lit("#000").alias("color"), i.alias("created_at"),
        ev.no_tags().alias("tags"), F.lit("agent").alias("origin"), F.lit(0.5).alias("confidence"),
    )


INC = "inc AS (SELECT 'e' || (seq + seq % 3) AS id, seq AS ord, ts_ns AS ns FROM tel WHERE channel_id = 'click')"
BASE = "base AS (SELECT * REPLACE ('e' || ord AS id) FROM ev)"


def e3(spark, sf_dir):
    return ev.upsert_events(_unique(spark, sf_dir), _incoming(spark, sf_dir), by=["id"]).select("id", "ord", "ns", "after_ns", "label", "status", "block")


def e3_counts(spark, sf_dir):
    return ev.upsert_counts(ev.upsert_events(_unique(spark, sf_dir), _incoming(spark, sf_dir), by=["id"]))


def e4(spark, sf_dir):
    out = ev.make_events(_unique(spark, sf_dir), T0)
    return rounded(out.select("id", "ns", "before_ns", "after_ns", "label", "confidence"), "confidence")


def _edits(spark, sf_dir):
    b = _unique(spark, sf_dir)
    n = F.col("ord")
    none = F.lit(None)

    def op(cond, seq, name, attr=none, value=none, before=none, after=none):
        cols = [F.lit(name).alias("op"), attr.cast("string").alias("attr"), value.cast("string").alias("value"), before.cast("bigint").alias("before_ns"), after.cast("bigint").alias("after_ns")]
        return b.filter(cond).select((n * 10 + seq).alias("seq"), "id", *cols)

    parts = [
        op(n % 3 == 0, 0, "label", value=F.lit(" first ")), op(n % 6 == 0, 1, "label", value=F.concat(F.lit("again "), n.cast("string"))), op(n % 3 == 1, 2, "label", value=F.lit("   ")),
        op(n % 4 == 0, 3, "range", before=F.lit(-5), after=n), op(n % 5 == 0, 4, "tag", F.lit("weather"), F.lit(" ")), op(n % 5 == 1, 5, "tag", F.lit("weather"), F.lit("sun")),
        op(n % 10 == 1, 6, "tag", F.lit("road"), F.lit("wet")), op(n % 20 == 1, 7, "tag", F.lit("road"), F.lit("")), op(n % 11 == 0, 8, "delete"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def e5(spark, sf_dir):
    return _shown(ev.edit_events(_unique(spark, sf_dir), _edits(spark, sf_dir), ["id"]))


def e6(spark, sf_dir):
    keys = spark.createDataFrame([("weather",), ("k1",), ("k3",)], "id string")
    return _shown(ev.prune_tags(_unique(spark, sf_dir), keys))


def e6_many(spark, sf_dir):
    """Two sources that repeat ids, and more attributes than any list of literals would take."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    tags = F.create_map(F.concat(F.lit("a"), key), F.col("p_brand"), F.lit("gone"), F.lit("x"))
    events = p.select(F.concat(F.lit("s"), (F.col("p_partkey") % 2).cast("string")).alias("source_id"), F.concat(F.lit("e"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("id"), tags.alias("tags"))
    out = ev.prune_tags(events, p.filter("p_partkey % 3 <> 0").select(F.concat(F.lit("a"), key).alias("id")))
    return out.select("source_id", "id", F.array_join(F.map_keys("tags"), ",").alias("keys"))


def e7(spark, sf_dir):
    return ev.export_events(_unique(spark, sf_dir)).orderBy("ns", "id")


def k2(spark, sf_dir):
    return to_json_columns(telemetry(spark, sf_dir).select("channel_id", "ts_ns", "seq"))


def f1(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    spread = (F.col("ts_ns") - T0) % (F.col("seq") % 9 * 3_000_000_000_000 + 1)
    return t.select("seq", fmt_duration(spread - 5_000_000_000).alias("duration"), fmt_absolute(F.col("ts_ns")).alias("absolute"))


def f4(spark, sf_dir):
    url = F.when(F.col("page_id") % 9 == 0, F.concat("url", F.lit("/a%20b%2Bc+d.mf4?x=1"))).when(F.col("page_id") % 9 == 1, F.lit("not a url")).when(F.col("page_id") % 9 == 2, F.lit("https://host.example.org:80/?q=1")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", url_basename(url).alias("basename"))


def f5(spark, sf_dir):
    p = table(spark, sf_dir, "events")
    k = F.col("event_id")
    raw = F.when(k % 7 == 0, F.lit("  ")).when(k % 7 == 1, F.lit("-")).when(k % 7 == 2, F.concat(F.lit(" +"), k.cast("string"))).when(k % 7 == 3, F.concat(F.lit("-"), k.cast("string"), F.lit("000000000")))
    raw = raw.when(k % 7 == 4, F.concat(k.cast("string"), F.lit(".5"))).when(k % 7 == 5, F.col("props")).otherwise(k.cast("string"))
    return p.select("event_id", parse_ns(raw).alias("ns"))


QUERIES = {
    "e1_read_events": Query(
        e1,
        f"""WITH {TEL}, {EV}, {DOCS}, g AS (SELECT *, row_number() OVER (PARTITION BY d, raw_id ORDER BY ord) AS k FROM dd WHERE d NOT IN (SELECT d FROM bad))
        SELECT d::VARCHAR AS source_id, CASE WHEN k = 1 THEN raw_id ELSE raw_id || '_' || k END AS id, ns, greatest(before_ns, 0) AS before_ns, after_ns,
        coalesce(nullif(trim(label), ''), 'event') AS label, origin, {sql6('CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END')} AS confidence FROM g""",
    ),
    "e1_rejected_documents": Query(e1_rejected, f"WITH {TEL}, {EV}, {DOCS} SELECT d::VARCHAR AS source_id FROM bad"),
    "e2_migrate_events": Query(e2, f"WITH {TEL}, {EV}, {BASE} SELECT id, ns, 0::BIGINT AS before_ns, 0::BIGINT AS after_ns, label, '' AS tags, 'user' AS origin, NULL::DOUBLE AS confidence FROM base"),
    "e3_upsert_events": Query(
        e3,
        f"""WITH {TEL}, {EV}, {BASE}, {INC}, l AS (SELECT id, max_by(ns, ord) AS ns FROM inc GROUP BY id)
        SELECT b.id, b.ord, coalesce(l.ns, b.ns) AS ns, CASE WHEN l.id IS NULL THEN after_ns ELSE 7 END AS after_ns, CASE WHEN l.id IS NULL THEN label ELSE 'click' END AS label,
        CASE WHEN l.id IS NULL THEN 'kept' ELSE 'updated' END AS status, 0 AS block FROM base b LEFT JOIN l USING (id)
        UNION ALL SELECT id, ord, ns, 7, 'click', 'added', 1 FROM inc WHERE id NOT IN (SELECT id FROM base)""",
    ),
    "e3_upsert_counts": Query(
        e3_counts,
        f"""WITH {TEL}, {EV}, {BASE}, {INC} SELECT (SELECT count(*) FROM inc WHERE id NOT IN (SELECT id FROM base)) AS added,
        (SELECT count(*) FROM base WHERE id IN (SELECT id FROM inc)) AS updated""",
    ),
    "e4_make_events": Query(
        e4,
        f"""WITH {TEL}, {EV}, {BASE}, m AS (SELECT *, greatest(ns - {T0}, 0) // 1000000 AS ms FROM base)
        SELECT id, ns, greatest(before_ns, 0) AS before_ns, greatest(after_ns, 0) AS after_ns,
        CASE WHEN trim(label) <> '' THEN label ELSE 'bookmark @ ' || CASE WHEN ms >= 3600000 THEN CASE WHEN ms // 3600000 < 10 THEN '0' ELSE '' END || (ms // 3600000) || ':' ELSE '' END ||
          lpad(((ms // 60000) % 60)::VARCHAR, 2, '0') || ':' || lpad(((ms // 1000) % 60)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') END AS label,
        {sql6('CASE WHEN confidence IS NOT NULL THEN least(1.0, greatest(0.0, confidence)) END')} AS confidence FROM m""",
    ),
    "e5_edit_events": Query(
        e5,
        f"""WITH {TEL}, {EV}, {BASE} SELECT id, ns, CASE WHEN i % 4 = 0 THEN 0 ELSE before_ns END AS before_ns, CASE WHEN i % 4 = 0 THEN i ELSE after_ns END AS after_ns,
        CASE WHEN i % 6 = 0 THEN 'again ' || i WHEN i % 3 = 0 THEN 'first' ELSE label END AS label,
        'k' || (i % 4) || '=v' || CASE WHEN i % 10 = 1 AND i % 20 <> 1 THEN ',road=wet' ELSE '' END ||
        CASE WHEN i % 5 = 0 THEN '' WHEN i % 5 = 1 THEN ',weather=sun' ELSE ',weather=w' || (i % 3) END AS tags, origin, {sql6('confidence')} AS confidence
        FROM base WHERE i % 11 <> 0""",
    ),
    "e6_prune_tags": Query(e6, f"WITH {TEL}, {EV}, {BASE} SELECT id, ns, before_ns, after_ns, label, {TAGS.format(w='i % 4 NOT IN (1, 3)')} AS tags, origin, {sql6('confidence')} AS confidence FROM base"),
    "e6_prune_tags_many": Query(
        e6_many,
        "SELECT 's' || (p_partkey % 2) AS source_id, 'e' || (p_partkey // 2) AS id, CASE WHEN p_partkey % 3 <> 0 THEN 'a' || p_partkey ELSE '' END AS keys FROM part",
    ),
    "e7_export_events": Query(
        e7,
        f"""WITH {TEL}, {EV}, {BASE} SELECT id, ns, '{{"id":"' || id || '","ns":"' || ns || '","beforeNs":"' || before_ns || '","afterNs":"' || after_ns || '","label":"' || label ||
        '","color":"#fff","createdAt":' || i || ',"tags":{{"k' || (i % 4) || '":"v","weather":"w' || (i % 3) || '"}}' || CASE WHEN origin <> 'user' THEN ',"origin":"agent"' ELSE '' END ||
        CASE WHEN confidence IS NOT NULL THEN ',"confidence":' || confidence::DOUBLE ELSE '' END || '}}' AS json FROM base""",
    ),
    "k2_json_columns": Query(k2, f"""WITH {TEL} SELECT '{{"channel_id":"' || channel_id || '","ts_ns":"' || ts_ns || '","seq":"' || seq || '"}}' AS json FROM tel"""),
    "f1_time_text": Query(
        f1,
        f"""WITH {TEL}, d AS (SELECT seq, ts_ns, greatest((ts_ns - {T0}) % (seq % 9 * 3000000000000 + 1) - 5000000000, 0) // 1000000 AS ms FROM tel)
        SELECT seq, CASE WHEN ms >= 3600000 THEN lpad((ms // 3600000)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad(((ms // 60000) % 60)::VARCHAR, 2, '0') || ':' ||
        lpad(((ms // 1000) % 60)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') AS duration,
        strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d %H:%M:%S.%g') AS absolute FROM d""",
    ),
    "f4_url_basename": Query(
        f4,
        r"""WITH u AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN url || '/a%20b%2Bc+d.mf4?x=1' WHEN 1 THEN 'not a url' WHEN 2 THEN 'https://host.example.org:80/?q=1' ELSE url END AS url FROM pages),
        p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host, list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS seg FROM u)
        SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://') THEN url WHEN len(seg) > 0 THEN url_decode(replace(seg[-1], '+', '%2B')) ELSE host END AS basename FROM p""",
    ),
    "f5_parse_ns": Query(
        f5,
        """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN event_id WHEN 3 THEN -event_id * 1000000000 WHEN 6 THEN event_id END AS ns FROM events""",
    ),
}
