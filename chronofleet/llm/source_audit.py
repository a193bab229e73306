"""Divergence of sources within a language, ranked over cells of equal counts.

A term's smoothed share of a group depends on nothing but how often the group has it, so terms
of one (group count, language count) form a cell: the divergence is evaluated once per cell,
cells are ranked by value with their multiplicities summed up, equal values are merged, and
only cells that reach into the wanted ranks are expanded to terms, in UTF-8 order.

Two sources are compared over the whole vocabulary of their language. The vocabulary is cut
into shards and the sources into blocks; a task holds the counts of two blocks in one shard as
a dense matrix and gives one partial sum per pair of sources, never a row per term and pair.
All arithmetic is on integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofleet.llm.common import lowered, pieces, saved, strings, table

#: Documents of a language that must hold a term.
MIN_DOCS = 10
TOP_TERMS = 10
ONE = 1_000_000_000
#: Terms of a vocabulary shard and sources of a block, on average.
SHARD_TERMS = 1 << 14
BLOCK_SOURCES = 32
#: Bytes of one document that are cut into terms at a time, and rows a task sums up before it sends them.
SLICE_BYTES = 4 << 20
HELD_ROWS = 1 << 19

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True

COUNTS = "lang string, source string, term string, n long, docs long"


def terms(buf: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of a buffer of rows, A-Z lower-cased, and the row of each."""
    solid = _LETTER[buf]
    border = np.zeros(len(buf) + 1, bool)
    border[offs] = True  # a new row ends the term before it
    starts = np.flatnonzero(solid & (~np.concatenate(([False], solid[:-1])) | border[:-1]))
    before = np.cumsum(solid)
    ends = np.append(before[starts] - 1, before[-1] if len(before) else 0).astype(np.int64)
    data = np.ascontiguousarray(lowered(buf)[solid])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return words, np.searchsorted(offs, starts, "right") - 1


def _slices(buf: np.ndarray):
    """Parts of one long text, cut where no term is cut."""
    at = 0
    while at < len(buf):
        to = min(at + SLICE_BYTES, len(buf))
        while to < len(buf) and _LETTER[buf[to - 1]] and _LETTER[buf[to]]:
            more = np.flatnonzero(~_LETTER[buf[to : to + SLICE_BYTES]])
            to += int(more[0]) if len(more) else min(SLICE_BYTES, len(buf) - to)
        yield buf[at:to]
        at = to


def _long_counts(buf: np.ndarray) -> pa.Table:
    """(term, n, docs) of one text, a slice at a time."""
    held = None
    for part in _slices(buf):
        found, _ = terms(part, np.array([0, len(part)]))
        counts = found.value_counts()
        t = pa.table({"term": counts.field("values"), "n": counts.field("counts")})
        held = t if held is None else pa.concat_tables([held, t])
        held = held.group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"])
    return held.append_column("docs", pa.array(np.ones(held.num_rows, np.int64)))


def _counted(batch: pa.RecordBatch) -> pa.Table | None:
    """(lang, source, term, n, docs) of a piece of rows."""
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    buf, offs = strings(batch.column("text"))
    if batch.num_rows == 1 and len(buf) > SLICE_BYTES:
        t = _long_counts(buf)
        found, n, docs = t["term"], t["n"], t["docs"]
        key = np.full(t.num_rows, group[0])
    else:
        words, row = terms(buf, offs)
        if not len(words):
            return None
        words = words.dictionary_encode()
        many = len(words.dictionary)
        each, times = np.unique(row * many + words.indices.to_numpy(), return_counts=True)
        key, back, docs = np.unique(group[each // many] * many + each % many, return_inverse=True, return_counts=True)
        n = np.bincount(back, times).astype(np.int64)
        found = words.dictionary.take(pa.array(key % many))
        key = key // many
    which = {"lang": (lang, key // len(source.dictionary)), "source": (source, key % len(source.dictionary))}
    cols = {c: d.dictionary.take(pa.array(k)).cast(pa.string()) for c, (d, k) in which.items()}
    return pa.table(cols | {"term": found.cast(pa.string()), "n": pa.array(n).cast(pa.int64()) if isinstance(n, np.ndarray) else n, "docs": docs})


def _term_counts(batches):
    """Counts of a task's rows, summed up until they are too many to hold."""
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        t = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])

    for b in batches:
        for piece in pieces(b, "text"):
            if (t := _counted(piece)) is not None:
                held.append(t)
            if sum(t.num_rows for t in held) > HELD_ROWS:
                held = [summed()]
                if held[0].num_rows > HELD_ROWS // 2:
                    yield from held.pop().to_batches(1 << 16)
    if held:
        yield from summed().to_batches(1 << 16)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents that hold it."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = rows.mapInArrow(_term_counts, COUNTS)
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str) -> Column:
    """1 + floor(ONE * (n + 2) / total), exact."""
    return F.expr(f"1 + (CAST({n} + 2 AS DECIMAL(20, 0)) * {ONE} div {total})")


def shares(n: np.ndarray, total: int) -> np.ndarray:
    """``share`` of many counts."""
    if len(n) and (int(n.max()) + 2) * ONE >= 1 << 63:
        n = n.astype(object)
    return (1 + (n + 2) * ONE // total).astype(np.int64)


PAIR = "lang string, source string, item string, value long"


def _pair_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of the divergence of all pairs of sources of two blocks over one vocabulary shard."""
    one, two = pdf["one"].iloc[0], pdf["two"].iloc[0]
    many = int(pdf["many"].iloc[0])
    p = np.empty((len(pdf), many), np.int64)
    for k, (idx, n, total) in enumerate(zip(pdf["idx"], pdf["n"], pdf["total"])):
        if many:
            own = np.zeros(many, np.int64)
            if idx is not None:
                own[np.asarray(idx, np.int64)] = n
            p[k] = shares(own, int(total))
    block = pdf["block"].to_numpy()
    out = []
    for k in range(len(pdf) - 1):
        rest = np.arange(k + 1, len(pdf))
        if one != two:
            rest = rest[block[rest] != block[k]]
        d, s = p[rest] - p[k], p[rest] + p[k]
        value = (d * d // s).sum(axis=1) if many else np.zeros(len(rest), np.int64)
        out.append(pd.DataFrame({"source": pdf["source"].iloc[k], "item": pdf["source"].to_numpy()[rest], "value": value}))
    found = pd.concat(out) if out else pd.DataFrame({"source": [], "item": [], "value": []})
    found.insert(0, "lang", pdf["lang"].iloc[0])
    return found.astype({"lang": object, "source": object, "item": object, "value": "int64"})


def _pairs(groups: DataFrame, kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language."""
    packed = kept.groupBy("lang", "source", "shard").agg(F.collect_list(F.struct("idx", "n")).alias("own"))
    packed = packed.select("lang", "source", "shard", F.col("own.idx").alias("idx"), F.col("own.n").alias("n"))
    rows = groups.select("lang", "source", "blocks", (F.col("words") + 2 * F.col("vocabulary")).alias("total"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    rows = rows.join(packed, ["lang", "source", "shard"], "left").join(sizes, ["lang", "shard"], "left")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("lang", "shard", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "block", "source", F.coalesce("many", F.lit(0)).alias("many"), "idx", "n", "total")
    sums = rows.groupBy("lang", "shard", "one", "two").applyInPandas(_pair_sums, PAIR)
    sums = sums.groupBy("lang", F.least("source", "item").alias("low"), F.greatest("source", "item").alias("high")).agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")), F.struct(F.col("high").alias("source"), F.col("low").alias("item"))))
    return sums.select("lang", "value", both.alias("pair")).select("lang", "pair.source", "pair.item", "value")


def _top_terms(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank) of the terms that a group has more of than its language."""
    key = ["lang", "source"]
    cells = kept.groupBy(*key, "n", "in_lang").agg(F.count("*").alias("many"))
    totals = groups.select(*key, (F.col("words") + 2 * F.col("vocabulary")).alias("total"), (F.col("lang_words") + 2 * F.col("vocabulary")).alias("lang_total"))
    cells = cells.join(totals, key).withColumns({"p": share("n", "total"), "q": share("in_lang", "lang_total")})
    cells = saved(cells.filter("p > q").select(*key, "n", "in_lang", "many", F.expr("(p - q) * (p - q) div (p + q)").alias("value")))
    # Of the merged values TOP_TERMS are enough, as each stands for a term at least.
    best = Window.partitionBy(*key).orderBy(F.desc("value"))
    values = cells.groupBy(*key, "value").agg(F.sum("many").alias("many"))
    values = values.withColumn("nth", F.row_number().over(best)).filter(f"nth <= {TOP_TERMS}")
    values = values.withColumn("before", F.coalesce(F.sum("many").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    values = values.filter(f"before < {TOP_TERMS}").select(*key, "value", "before")
    found = kept.join(cells.join(values, [*key, "value"]).select(*key, "n", "in_lang", "value", "before"), [*key, "n", "in_lang"])
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "value").orderBy("term"))).filter(f"nth <= {TOP_TERMS}")
    found = found.withColumn("rank", (F.col("before") + F.col("nth")).cast("int")).filter(f"rank <= {TOP_TERMS}")
    return found.select(*key, F.col("term").alias("item"), "value", "rank")


def audited(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) group of ``docs``.

    Part ``pair`` ranks the other sources of the language by the divergence summed over the
    language's vocabulary, part ``term`` the TOP_TERMS terms the group has more of than its
    language by their own divergence. Null text, lang and source count as ''; every row is a
    document, repeated rows count each, ids are not read. Ties rank by item in UTF-8 order. A
    group without terms and a language without vocabulary have pairs (of value 0 where there is no
    vocabulary) and no terms. Long texts are cut into terms in slices, other columns are
    ignored, and an empty table gives an empty one.
    """
    counts = saved(term_counts(docs))
    every = saved(counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).filter(f"docs >= {MIN_DOCS}").drop("docs"))
    langs = saved(every.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("in_lang").alias("lang_words")).withColumn("shards", F.ceil(F.col("vocabulary") / SHARD_TERMS).cast("int")))
    every = every.join(langs.select("lang", "shards"), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))
    every = saved(every.withColumn("idx", F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1).select("lang", "term", "in_lang", "shard", "idx"))
    sizes = every.groupBy("lang", "shard").agg(F.count("*").alias("many"))
    kept = saved(counts.drop("docs").join(every, ["lang", "term"]))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    words = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK_SOURCES).cast("int").alias("blocks"))
    groups = groups.join(words, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["words", "vocabulary", "lang_words"]).fillna(1, ["shards"])
    groups = saved(groups.join(blocks, "lang"))
    ranked = _pairs(groups, kept, sizes).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    parts = [x.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for name, x in (("pair", ranked), ("term", _top_terms(groups, kept)))]
    return parts[0].union(parts[1])


def query(spark, sf_dir):
    return audited(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
t AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
vocab AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS words FROM vocab GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN vocab USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS words FROM counts GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
dense AS (
    SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
        1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.words, 0) + 2 * l.v) AS p,
        1 + 1000000000::HUGEINT * (v.n + 2) // (l.words + 2 * l.v) AS q
    FROM groups g JOIN vocab v USING (lang) JOIN langs l USING (lang)
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
    LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source),
divergence AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN divergence x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
own AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
    row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank
FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank
FROM own QUALIFY rank <= 10
"""
