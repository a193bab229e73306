"""Annotated time spans: import, merge, edit, prune and export.

``events(id, ns, before_ns, after_ns, label, color, created_at, tags MAP, origin,
confidence)``; frames that carry an order have it in ``ord``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofleet.functions.text import clean
from chronofleet.functions.time import fmt_relative
from chronofleet.operators.catalog import dedupe_names
from chronofleet.sources.annotations import read_documents

FIELDS = ("id", "ns", "before_ns", "after_ns", "label", "color", "created_at", "tags", "origin", "confidence")
#: Ids are unique within a source only.
EVENT_KEY = ("source_id", "id")
SCHEMA_VERSION = 2
SAFE_INTEGER = 2**53 - 1

_NO_TAGS = "map<string,string>"

#: A document is one row of the input, so its entries have been together in a task before: they are
#: ordered there too, without counting them first.
DOC_ENTRIES = 500_000


def no_tags() -> Column:
    return F.create_map().cast(_NO_TAGS)


# -- import ----------------------------------------------------------------------
def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _get(e: Column, key: str) -> Column:
    return F.try_variant_get(e, f"$.{key}", "variant")


def _str(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _num(v: Column) -> Column:
    return F.when(_kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))


def _ns(v: Column) -> Column:
    """Decimal string (blank is 0) or integral JSON number within 2^53."""
    text = F.trim(_str(v))
    written = F.when(text == "", F.lit(0).cast("bigint")).when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    number = _num(v)
    whole = F.when((number == F.floor(number)) & (F.abs(number) <= SAFE_INTEGER), number.try_cast("bigint"))
    return F.coalesce(written, whole)


def _decoded(rows: DataFrame) -> DataFrame:
    """Event columns of one entry variant ``e`` per row; ``ok`` is false when unusable."""
    keys = {"ns": "_ns", "beforeNs": "_b", "afterNs": "_a", "tags": "_t", "origin": "_o", "confidence": "_c", "id": "_i", "label": "_l", "color": "_k", "createdAt": "_m"}
    raw = rows.withColumns({name: _get(F.col("e"), key) for key, name in keys.items()})
    zero = F.lit(0).cast("bigint")
    absent = F.col("_c").isNull() | (_kind(F.col("_c")) == "VOID")
    staged = raw.withColumns(
        {
            "ns": _ns(F.col("_ns")),
            "before_ns": F.when(F.col("_b").isNull(), zero).otherwise(_ns(F.col("_b"))),
            "after_ns": F.when(F.col("_a").isNull(), zero).otherwise(_ns(F.col("_a"))),
            "_map": F.try_variant_get("_t", "$", "map<string,variant>"),
            "origin": F.when(F.col("_o").isNull(), F.lit("user")).otherwise(_str(F.col("_o"))),
            "confidence": F.when(~absent, _num(F.col("_c"))),
            "_absent": absent,
            "_id": F.nullif(_str(F.col("_i")), F.lit("")),
            "label": F.coalesce(clean(_str(F.col("_l"))), F.lit("event")),
            "color": F.nullif(_str(F.col("_k")), F.lit("")),
            "created_at": _num(F.col("_m")).cast("bigint"),
        }
    )
    tags = F.when(F.col("_t").isNull(), no_tags()).otherwise(F.transform_values("_map", lambda k, v: _str(v)))
    tags_ok = F.col("_t").isNull() | F.forall(F.map_values("_map"), lambda v: _kind(v) == "STRING")
    ok = (
        _kind(F.col("e")).startswith("OBJECT")
        & F.col("ns").isNotNull()
        & (F.col("before_ns") >= 0)
        & (F.col("after_ns") >= 0)
        & tags_ok
        & F.col("origin").isin("user", "agent")
        & (F.col("_absent") | F.col("confidence").between(0.0, 1.0))
    )
    columns = ["source_id", "ord", "_id", "ns", "before_ns", "after_ns", "label", "color", "created_at", "origin", "confidence"]
    return staged.select(*columns, tags.alias("tags"), F.coalesce(ok, F.lit(False)).alias("ok"))


def parse_events(docs: DataFrame, now_ms: int = 0, target_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Events of accepted documents (``source_id, doc``) and the rejected documents.

    Accepts a wrapper or object with ``bookmarks``, or a bare array. Only ``ns`` is
    required per entry; one bad entry rejects its whole document, since a partial import
    would lose findings unseen. Missing ids are derived from document and position;
    repeated ids within a document get ``_2``, ``_3`` and so on.
    """
    v = docs.select("source_id", F.try_parse_json("doc").alias("v"))
    top = F.try_variant_get("v", "$", "array<variant>")
    wrapped = F.try_variant_get("v", "$.bookmarks", "array<variant>")
    listed = v.select("source_id", F.coalesce(top, wrapped).alias("raw"))
    entries = _decoded(listed.select("source_id", F.posexplode("raw").alias("ord", "e")))
    bad_entry = entries.filter(~F.col("ok")).select("source_id")
    rejected = listed.filter(F.col("raw").isNull()).select("source_id").union(bad_entry).distinct()
    minted = F.concat(F.lit("bm-"), F.hex(F.xxhash64("source_id", "ord")))
    rows = entries.withColumns({"_id": F.coalesce("_id", minted), "ord": F.col("ord").cast("bigint")}).drop("ok")
    good = rows.join(rejected, "source_id", "left_anti")
    named = dedupe_names(good, "_id", "ord", ["source_id"], "%s_%d", r"^(.*)_(\d+)$", target_rows, at_most=DOC_ENTRIES)
    out = named.withColumn("created_at", F.coalesce("created_at", F.lit(now_ms).cast("bigint"))).withColumnRenamed("unique_name", "id")
    return out.select("source_id", "ord", *FIELDS), rejected


def read_events(spark: SparkSession, paths, now_ms: int = 0) -> tuple[DataFrame, DataFrame]:
    """Events of JSON files; see :func:`parse_events`."""
    return parse_events(read_documents(spark, paths), now_ms)


def migrate_events(v1: DataFrame) -> DataFrame:
    """Version-1 events (id, ns, label, color, created_at) in the current shape."""
    zero = F.lit(0).cast("bigint")
    return v1.select(
        *[c for c in ("source_id", "ord") if c in v1.columns],
        "id", "ns", zero.alias("before_ns"), zero.alias("after_ns"), "label", "color", "created_at",
        no_tags().alias("tags"), F.lit("user").alias("origin"), F.lit(None).cast("double").alias("confidence"),
    )


# -- create and merge ------------------------------------------------------------
def make_events(df: DataFrame, start_ns: int = 0) -> DataFrame:
    """Clamp durations to zero and confidence to 0..1; name unlabelled events by time."""
    text = clean(F.col("label"))
    label = F.coalesce(text, F.concat(F.lit("bookmark @ "), fmt_relative(F.col("ns"), F.lit(start_ns).cast("bigint"))))
    zero = F.lit(0).cast("bigint")
    return df.withColumns(
        {
            "before_ns": F.greatest(F.coalesce("before_ns", zero), zero),
            "after_ns": F.greatest(F.coalesce("after_ns", zero), zero),
            "label": label,
            "confidence": F.when(F.col("confidence").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence")))),
        }
    )


def upsert_events(base: DataFrame, incoming: DataFrame, mode: str = "merge", by: Sequence[str] = EVENT_KEY) -> DataFrame:
    """Merge by key: an incoming event replaces its namesake in place, new ones follow.

    Ids are unique within a source, so ``by`` names the source too. Both frames carry
    ``ord``; the result adds ``status`` (kept, updated, added) and ``block`` so that
    ``orderBy("block", "ord")`` is the merged order. Each frame is read once: a full outer
    join meets the incoming events as one list per key. ``replace`` drops the base.
    """
    by = list(by)
    rest = [c for c in base.columns if c not in (*by, "ord")]
    if mode == "replace":
        return incoming.select(*base.columns).withColumns({"status": F.lit("added"), "block": F.lit(0)})
    if mode != "merge":
        raise ValueError(f"mode must be merge or replace, not {mode!r}")
    listed = incoming.groupBy(*by).agg(F.collect_list(F.struct("ord", F.struct(*rest).alias("e"))).alias("_in"), F.max_by(F.struct(*rest), "ord").alias("_last"))
    kept = base.select(*by, F.struct("ord", F.struct(*rest).alias("e")).alias("_old"))
    both = kept.join(listed, by, "full_outer")
    old, new, last = F.col("_old"), F.col("_in"), F.col("_last")

    def row(ord_, e, status, block):
        return F.struct(ord_.alias("ord"), e.alias("e"), F.lit(status).alias("status"), F.lit(block).alias("block"))

    stays = F.when(new.isNull(), row(old["ord"], old["e"], "kept", 0)).otherwise(row(old["ord"], last, "updated", 0))
    rows = F.when(old.isNotNull(), F.array(stays)).otherwise(F.transform(new, lambda x: row(x["ord"], x["e"], "added", 1)))
    out = both.select(*by, F.explode(rows).alias("_r"))
    cols = [F.col(c) if c in by else F.col("_r.ord") if c == "ord" else F.col("_r.e")[c].alias(c) for c in base.columns]
    return out.select(*cols, "_r.status", "_r.block")


def upsert_counts(merged: DataFrame) -> DataFrame:
    """How many events a merge added and updated."""
    return merged.agg(F.count_if(F.col("status") == "added").alias("added"), F.count_if(F.col("status") == "updated").alias("updated"))


# -- edits -----------------------------------------------------------------------
def edit_events(base: DataFrame, edits: DataFrame, by: Sequence[str] = EVENT_KEY) -> DataFrame:
    """Apply ``edits(seq, *by, op, attr, value, before_ns, after_ns)`` in ``seq`` order.

    Operations: ``label`` (a blank one is ignored), ``range`` (negatives become 0),
    ``tag`` (a blank value removes the attribute), ``delete``.
    """
    by = list(by)
    op = F.col("op")
    text = clean(F.col("value"))
    zero = F.lit(0).cast("bigint")
    span = F.struct(F.greatest("before_ns", zero).alias("before"), F.greatest("after_ns", zero).alias("after"))
    renames, ranges = (op == "label") & text.isNotNull(), op == "range"
    plain = edits.groupBy(*by).agg(
        F.max_by(F.when(renames, text), F.when(renames, F.col("seq"))).alias("_label"),
        F.max_by(F.when(ranges, span), F.when(ranges, F.col("seq"))).alias("_span"),
        F.coalesce(F.bool_or(op == "delete"), F.lit(False)).alias("_gone"),
    )
    # The last edit per attribute first, so the list per event is at most its attributes.
    tags = edits.filter(op == "tag").groupBy(*by, "attr").agg(F.max_by(F.struct("value"), "seq").alias("v"))
    tags = tags.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("attr", F.col("v.value").alias("value")))).alias("_tags"))
    joined = base.join(plain, by, "left").join(tags, by, "left").filter(~F.coalesce("_gone", F.lit(False)))
    kept = F.map_filter("tags", lambda k, v: ~F.map_contains_key("_tags", k))
    added = F.map_filter("_tags", lambda k, v: F.trim(v) != "")
    return joined.select(
        *[
            F.coalesce("_label", "label").alias(c) if c == "label"
            else F.coalesce("_span.before", c).alias(c) if c == "before_ns"
            else F.coalesce("_span.after", c).alias(c) if c == "after_ns"
            else F.when(F.col("_tags").isNull(), F.col("tags")).otherwise(F.map_concat(kept, added)).alias(c) if c == "tags"
            else F.col(c)
            for c in base.columns
        ]
    )


def prune_tags(events: DataFrame, attributes: DataFrame) -> DataFrame:
    """Drop tags whose attribute is not in ``attributes(id)``.

    One plan for a taxonomy of any size: the distinct attributes of the tags in use are
    joined with it, and events take back what is left of theirs. Rows that repeat a key keep
    their own tags.
    """
    mine = events.withColumn("_keys", F.array_sort(F.map_keys("tags")))
    sets = mine.select("_keys").distinct()
    valid = sets.select("_keys", F.explode("_keys").alias("attr")).join(attributes.select(F.col("id").alias("attr")).distinct(), "attr")
    allowed = valid.groupBy("_keys").agg(F.collect_list("attr").alias("_ok"))
    out = mine.join(allowed, "_keys", "left")
    kept = F.map_filter("tags", lambda k, v: F.array_contains(F.coalesce("_ok", F.array().cast("array<string>")), k))
    return out.withColumn("tags", kept).select(*events.columns)


# -- export ----------------------------------------------------------------------
def export_events(events: DataFrame) -> DataFrame:
    """``ns`` and one JSON object per event; order by ``ns`` at the sink.

    Nanoseconds are decimal strings; a user origin and a missing confidence are left out.
    """
    fields = F.struct(
        F.col("id"),
        F.col("ns").cast("string").alias("ns"),
        F.col("before_ns").cast("string").alias("beforeNs"),
        F.col("after_ns").cast("string").alias("afterNs"),
        F.col("label"),
        F.col("color"),
        F.col("created_at").alias("createdAt"),
        F.map_from_entries(F.array_sort(F.map_entries("tags"))).alias("tags"),
        F.when(F.col("origin") != "user", F.col("origin")).alias("origin"),
        F.col("confidence"),
    )
    return events.select("id", "ns", F.to_json(fields).alias("json"))


def write_events(events: DataFrame, path: str) -> None:
    """Newline-delimited JSON in time order."""
    export_events(events).orderBy("ns", "id").select("json").write.mode("errorifexists").text(path)
