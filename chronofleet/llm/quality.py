"""Document quality by the perplexity of a Kneser-Ney model of trusted text.

The model is an interpolated modified Kneser-Ney model over the bytes of all trusted documents,
ORDER bytes long; an n-gram fits in an integer, so counts are exact. Batches of documents
(``batches.py``) count their n-grams and send each distinct one to its shard, where counts meet;
discounts, continuation counts and back-off weights are joins and groups over distinct n-grams.
Each n-gram of the corpus is given its probability once, goes back to the batches that asked, and
they sum their documents. A document is kept if its perplexity is at most a quantile, of its
language, of the trusted documents' perplexities.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofleet.llm import batches as bt
from chronofleet.llm.common import PIECE_BYTES, ready, saved, shuffle_partitions, table

ORDER = 5
#: Trusted documents of a language that are at most this perplex, in parts of all.
QUANTILE = 0.995
#: One trusted document in so many is not counted; the quantile is taken over these, as a document
#: the model has counted is less perplex than any other.
HELD_OUT = 5
#: A document counts as if this many further bytes were as likely as its language's average, so
#: that a few words don't decide.
PRIOR_BYTES = 60
BUCKET_KEYS = 1 << 20
#: Text of a batch: the larger, the fewer n-grams are asked for again and again.
BATCH_BYTES = 12 << 20
#: No discount is below this, so that no byte is impossible.
LEAST_DISCOUNT = 0.05
#: Log probabilities travel in steps of 1 / SCALE.
SCALE = 2048
#: Quantiles are exact on scores rounded to 1 / BINS.
BINS = 1000

_MASK = np.uint64((1 << bt.KEY_BITS) - 1)
_ODD = np.uint64(0x9E3779B97F4B)
_BACK = np.uint64(pow(0x9E3779B97F4B, -1, 1 << bt.KEY_BITS))


def grams(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The ORDER-gram that ends at each byte; before a document stand zero bytes."""
    out = buf.astype(np.uint64)
    start = np.repeat(offs[:-1], np.diff(offs))
    age = np.arange(len(buf)) - start
    g = out.copy()
    for k in range(1, ORDER):
        prev = np.zeros(len(buf), np.uint64)
        prev[k:] = out[:-k]
        prev[age < k] = 0
        g |= prev << np.uint64(8 * k)
    return g


def _keys(g: np.ndarray) -> np.ndarray:
    """Grams spread over the key space, one to one."""
    return g * _ODD & _MASK


def _row_pieces(buf: np.ndarray, offs: np.ndarray):
    at, last = 0, len(offs) - 1
    while at < last:
        to = min(max(int(np.searchsorted(offs, offs[at] + PIECE_BYTES, "right")) - 1, at + 1), last)
        yield at, to, buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def _distinct(buf: np.ndarray, offs: np.ndarray, trusted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a batch and how often its trusted documents have them."""
    keys, counts = [], []
    for a, b, part, cut in _row_pieces(buf, offs):
        g = _keys(grams(part, cut))
        if trusted is None:
            keys.append(np.unique(g))
            continue
        good = np.repeat(trusted[a:b], np.diff(cut))
        u, inverse = np.unique(g, return_inverse=True)
        keys.append(u)
        counts.append(np.bincount(inverse, good, len(u)))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0)
    if trusted is None:
        return np.unique(np.concatenate(keys)), np.zeros(0)
    u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(inverse, np.concatenate(counts), len(u))


def _ask(buckets: int):
    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        good = right["doc_id"].to_numpy()
        for _, r in left.iterrows():
            ids, buf, offs = bt.unpacked(r)
            keys, counts = _distinct(buf, offs, np.isin(ids, good))
            at = bt.cuts(keys, buckets)
            for i in range(buckets):
                if at[i + 1] > at[i]:
                    out.append((i, r["batch"], at[i + 1] - at[i], bt.encoded(keys[at[i] : at[i + 1]]), counts[at[i] : at[i + 1]].astype(np.uint32).tobytes()))
        return pd.DataFrame(out, columns=["bucket", "batch", "n", "keys", "counts"])

    return ask


def _met(pdf: pd.DataFrame) -> pd.DataFrame:
    """The distinct grams of a bucket with their trusted counts."""
    keys = np.concatenate([bt.decoded(k, m) for k, m in zip(pdf["keys"], pdf["n"])])
    counts = np.concatenate([np.frombuffer(c, np.uint32) for c in pdf["counts"]])
    u, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, counts, len(u)).astype(np.int64)
    return pd.DataFrame({"bucket": pdf["bucket"].iloc[0], "gram": (u * _BACK & _MASK).astype(np.int64), "c": total})


def _answers(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """For each key a batch asked for, its negative log probability."""
    k = _keys(known["gram"].to_numpy().astype(np.uint64))
    order = np.argsort(k)
    k, cost = k[order], known["cost"].to_numpy()[order].astype(np.uint16)
    out = [cost[np.searchsorted(k, bt.decoded(x, m))].tobytes() for x, m in zip(asked["keys"], asked["n"])]
    return pd.DataFrame({"batch": asked["batch"], "bucket": asked["bucket"], "answers": out})


SCORED = "batch long, doc_id long, tag string, n_bytes long, cost long"


def _score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, r in left.iterrows():
        ids, buf, offs = bt.unpacked(r)
        keys, _ = _distinct(buf, offs)
        cost = np.frombuffer(b"".join(right.sort_values("bucket")["answers"]), np.uint16)
        total = np.zeros(len(ids), np.int64)
        for a, b, part, cut in _row_pieces(buf, offs):
            sums = np.concatenate([[0], np.cumsum(cost[np.searchsorted(keys, _keys(grams(part, cut)))], dtype=np.int64)])
            total[a:b] = sums[cut[1:]] - sums[cut[:-1]]
        out.append(pd.DataFrame({"batch": r["batch"], "doc_id": ids, "n_bytes": np.diff(offs), "cost": total, "tag": bt.tags_of(r)}))
    return pd.concat(out)[["batch", "doc_id", "tag", "n_bytes", "cost"]] if out else pd.DataFrame(columns=["batch", "doc_id", "tag", "n_bytes", "cost"])


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of one order from its counts of counts."""
    n = {r["c"]: r["many"] for r in counts.filter("c BETWEEN 1 AND 4").groupBy("c").agg(F.count("*").alias("many")).collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2 or not n3:
        return 0.5, 1.0, 1.5  # too little text to tell
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, LEAST_DISCOUNT), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def model(top: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per order 1.. the tables (gram, p) of seen n-grams and (context, back) of back-off weights.

    ``top`` has the ORDER-grams with their counts; lower orders count how many different bytes
    stand before a gram.
    """
    counts = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):
        cut = F.col("gram").bitwiseAND((1 << 8 * k) - 1)
        counts[k] = saved(counts[k + 1].groupBy(cut.alias("gram")).agg(F.count("*").alias("c")))
    seen, backs = [], []
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(counts[k])
        disc = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = counts[k].withColumns({"context": F.shiftright("gram", 8), "less": disc})
        back = rows.groupBy("context").agg((F.sum("less") / F.sum("c")).alias("back"), F.sum("c").alias("total"))
        back = saved(back)
        rows = rows.join(back, "context").withColumn("own", (F.col("c") - F.col("less")) / F.col("total"))
        if k == 1:
            rows = rows.select("gram", (F.col("own") + F.col("back") / 256).alias("p"))
        else:
            lower = seen[-1].select(F.col("gram").alias("tail"), F.col("p").alias("lower"))
            rows = rows.withColumn("tail", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(lower, "tail")
            rows = rows.select("gram", (F.col("own") + F.col("back") * F.col("lower")).alias("p"))
        seen.append(saved(rows))
        backs.append(back.select("context", "back"))
    return seen, backs


def costs(wanted: DataFrame, seen: list[DataFrame], backs: list[DataFrame]) -> DataFrame:
    """(bucket, gram, cost) for every wanted ORDER-gram, backing off where it was not seen."""
    out = wanted.select("bucket", "gram").withColumns({"p": F.lit(None).cast("double"), "weight": F.lit(1.0)})
    for k in range(ORDER, 0, -1):
        tail = F.col("gram").bitwiseAND((1 << 8 * k) - 1)
        out = out.withColumns({"tail": tail, "before": F.shiftright(tail, 8)})
        hit = seen[k - 1].select(F.col("gram").alias("tail"), F.col("p").alias("hit"))
        out = out.join(hit, "tail", "left").join(backs[k - 1].select(F.col("context").alias("before"), "back"), "before", "left")
        out = out.select(
            "bucket", "gram", F.coalesce("p", F.col("weight") * F.col("hit")).alias("p"),
            F.when(F.col("p").isNull() & F.col("hit").isNull(), F.col("weight") * F.coalesce("back", F.lit(1.0))).otherwise(F.col("weight")).alias("weight"),
        )
    p = F.coalesce("p", F.col("weight") / 256)
    return out.select("bucket", "gram", F.least(F.round(-F.log(p) * SCALE), F.lit(65535)).cast("int").alias("cost"))


def scores(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, total_bits and held (trusted but not counted) per row with an id."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("tag"))
    packs = bt.packed(rows, tagged=True, batch_bytes=BATCH_BYTES)
    good = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    where = packs.select("batch", "ids").mapInArrow(_ids, "batch long, doc_id long")
    good = where.join(good, "doc_id", "left_semi").distinct().withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0)
    held, good = good.filter("held").drop("held"), good.filter("NOT held").drop("held")
    total = where.count()
    buckets = ready(shuffle_partitions(spark), total, BUCKET_KEYS)
    asked = saved(packs.groupBy("batch").cogroup(good.groupBy("batch")).applyInPandas(_ask(buckets), bt.ASKED))
    met = saved(asked.groupBy("bucket").applyInPandas(_met, "bucket int, gram long, c long"))
    seen, backs = model(met.filter("c > 0").select("gram", "c"))
    known = costs(met, seen, backs)
    answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInPandas(_answers, bt.ANSWERED)
    out = saved(packs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(_score, SCORED))
    mine = held.select(F.col("doc_id").alias("good"), F.col("batch").alias("in"))
    out = out.join(mine, (F.col("doc_id") == F.col("good")) & (F.col("batch") == F.col("in")), "left")
    bits = F.col("cost") / (SCALE * float(np.log(2.0)))
    return out.select("doc_id", F.col("tag").alias("lang"), "n_bytes", bits.alias("total_bits"), F.col("good").isNotNull().alias("held"))


def _ids(batches):
    for r in bt.rows_of(batches):
        ids = np.frombuffer(r["ids"], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["batch"])), pa.array(ids)], ["batch", "doc_id"])


def thresholds(rows: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, limit): the quantile of ``score`` over each language's rows, from a histogram."""
    bins = rows.groupBy("lang", F.ceil(F.col("score") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy("bin")
    part = bins.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy("lang"))})
    return part.filter(F.col("upto") >= F.col("all") * quantile).groupBy("lang").agg((F.min("bin") / BINS).alias("limit"))


def classified(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, n_bytes, perplexity (per byte), threshold, kept per row of ``docs``.

    ``trusted`` lists the ids of trusted documents. A null language is one of its own; a language
    without trusted text uses the quantile of all. Null and empty texts and rows without an id have
    no perplexity and are kept; without any trusted text nothing is known and all are kept. Rows that
    repeat an id are scored each, texts of any length whole; other columns are ignored, and an
    empty table gives an empty one.
    """
    each = saved(scores(docs, trusted))
    mean = each.filter("held AND n_bytes > 0").groupBy("lang").agg((F.sum("total_bits") / F.sum("n_bytes")).alias("mean"))
    overall = each.filter("held AND n_bytes > 0").agg((F.sum("total_bits") / F.sum("n_bytes")).alias("m")).first()["m"]
    mean = mean.withColumnRenamed("lang", "of")
    each = each.join(mean, F.col("lang").eqNullSafe(F.col("of")), "left")
    score = (F.col("total_bits") + PRIOR_BYTES * F.coalesce("mean", F.lit(overall))) / (F.col("n_bytes") + PRIOR_BYTES)
    each = saved(each.withColumn("score", score).drop("mean", "of"))
    good = each.filter("held AND n_bytes > 0")
    per = thresholds(good, quantile).withColumnRenamed("lang", "of")
    whole = thresholds(good.withColumn("lang", F.lit("")), quantile).first()
    out = each.join(per, F.col("lang").eqNullSafe(F.col("of")), "left")
    limit = F.coalesce("limit", F.lit(None if whole is None else whole["limit"]).cast("double"))
    told = F.when(F.col("n_bytes") > 0, F.pow(F.lit(2.0), F.col("score")))
    out = out.select("doc_id", "n_bytes", told.alias("perplexity"), F.pow(F.lit(2.0), limit).alias("threshold"), F.coalesce((F.col("score") <= limit) | (F.col("n_bytes") == 0), F.lit(True)).alias("kept"))
    lost = docs.filter("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    return out.union(lost)


def query(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").filter("quality = 1")
    return classified(table(spark, sf_dir, "documents"), labels)


SQL = None
