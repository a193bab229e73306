"""Mixing sources to target weights by entropy balancing.

Among all document rates ``r`` with ``0 <= r <= MOST`` that give every source its target
number of words, the one nearest to 1 in relative entropy is exponentially tilted:
``r = min(MOST, exp(tilt[source] * size / scale))``. The tilts solve a convex dual with one
variable per source; Newton steps, safeguarded by bisection, find them. Rates depend on
(source, size) only, so every step reads the histogram of sizes, not the documents, and the
state is a table with one row per source.

Rates become whole copies: along a source's sizes from large to small the error made so far is
handed on, so the words taken miss the target by no more than the small sizes at the end. Which
documents of one size get the extra copy follows from a hash of the id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofleet.llm.common import saved, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
#: No document and no source exceeds this many times its size.
MOST = 2.0
TOLERANCE = 1e-9
#: Newton steps, where they leave the bracket halvings of it; a source that needs more is an error.
NEWTON_STEPS = 200
#: Documents of one source and size that one task ranks.
RANK_ROWS = 1 << 17


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size) with size the number of words; null text has none."""
    solid = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\f\r", "     ")
    words = F.size(F.filter(F.split(solid, " "), lambda w: w != ""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), words.cast("long").alias("size"))


def targets(histogram: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): shares by weight, held at ``most`` times a source's size.

    What a source can't take is shared by weight among the others until none is above. That
    level is found in one pass: sources by room per weight, small first, are full as long as
    their room is below their share of what is left.
    """
    per = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumns({"weight": w, "room": F.col("source_size") * F.lit(float(most))})
    whole = Window.partitionBy()
    per = per.withColumns({"all_size": F.sum("source_size").over(whole), "all_weight": F.sum("weight").over(whole)})
    before = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"room_before": F.coalesce(F.sum("room").over(before), F.lit(0.0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    level = (F.col("all_size") * share - F.col("room_before")) / (F.col("all_weight") - F.col("weight_before"))
    full = F.col("room") <= level * F.col("weight")
    # The first source that isn't full sets the level of all that follow.
    open_level = F.min(F.when(~full, F.struct((F.col("room") / F.col("weight")).alias("key"), level.alias("level")))).over(whole)["level"]
    target = F.when(full, F.col("room")).otherwise(F.least(F.col("room"), open_level * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def tilts(histogram: DataFrame, goal: DataFrame, most: float = MOST) -> DataFrame:
    """(source, tilt, scale) by distributed Newton steps on the dual of every source.

    ``tilt`` is null where no finite tilt exists: the target is 0, or all rates are ``most``.
    """
    per = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum(F.col("size") * F.col("size") * F.col("n")).alias("squares"))
    state = goal.join(per, goal["source"].eqNullSafe(per["source"])).select(
        goal["source"].alias("source"), "target", (F.col("squares") / F.col("words")).alias("scale"),
        F.when((F.col("words") == 0) | (F.col("target") <= 0) | (F.col("target") >= F.col("words") * most * (1 - TOLERANCE)), None).otherwise(F.lit(0.0)).alias("tilt"),
        F.lit(-1e4).alias("low"), F.lit(1e4).alias("high"), F.lit(False).alias("done"),
    )
    state = saved(state.withColumn("done", F.col("tilt").isNull()))
    hist = histogram.select(F.col("source").alias("of"), "size", "n")
    for _ in range(NEWTON_STEPS):
        if state.filter(~F.col("done")).isEmpty():
            break
        open_ = state.filter(~F.col("done"))
        z = F.col("size") / F.col("scale")
        raw = F.exp(F.least(F.col("tilt") * z, F.lit(50.0)))
        rate = F.least(F.lit(float(most)), raw)
        step = hist.join(open_, F.col("of").eqNullSafe(F.col("source"))).groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"),
            F.sum(F.when(raw < most, F.col("n") * F.col("size") * z * raw).otherwise(0.0)).alias("slope"),
        ).withColumnRenamed("source", "of")
        nxt = state.join(step, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        above = F.col("got") > F.col("target")
        low = F.when(F.col("got").isNotNull() & ~above, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(above, F.col("tilt")).otherwise(F.col("high"))
        nxt = nxt.withColumns({"low": low, "high": high})
        newton = F.col("tilt") - (F.col("got") - F.col("target")) / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        met = F.abs(F.col("got") - F.col("target")) <= F.col("target") * TOLERANCE
        nxt = nxt.withColumns(
            {
                "done": F.col("done") | F.coalesce(met, F.lit(False)),
                "tilt": F.when(F.col("done") | F.coalesce(met, F.lit(True)), F.col("tilt")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2),
            }
        )
        state = saved(nxt.select("source", "target", "scale", "tilt", "low", "high", "done"))
    else:
        if not state.filter(~F.col("done")).isEmpty():
            raise ArithmeticError(f"tilts did not converge in {NEWTON_STEPS} steps")
    return state.select("source", "target", "tilt", "scale")


def _copies(pdf: pd.DataFrame) -> pd.DataFrame:
    """How many copies all documents of a size get, from large to small sizes of one source."""
    pdf = pdf.sort_values("size", ascending=False)
    size, n, rate = (pdf[c].to_numpy() for c in ("size", "n", "rate"))
    base = np.floor(rate + 1e-9)
    extra = np.zeros(len(pdf), np.int64)
    owed = 0.0
    for i in range(len(pdf)):
        owed += n[i] * (rate[i] - base[i]) * size[i]
        if size[i] > 0:
            most = n[i] if rate[i] - base[i] > 1e-9 else 0
            extra[i] = min(max(round(owed / size[i]), 0), most)
            owed -= float(extra[i]) * float(size[i])
    return pdf.assign(base=base.astype("int64"), extra=extra)[["source", "size", "n", "rate", "base", "extra"]]


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken per row.

    Null text has size 0 and gets one copy of no words; a null source is a source of its own, the
    last. Rows without an id or that repeat one are ranked among those of equal hash in any
    order, which changes no sum. An empty table gives an empty table.
    """
    each = saved(sizes(docs, doc_id, text, source))
    histogram = saved(each.groupBy("source", "size").agg(F.count("*").alias("n")))
    goal = saved(targets(histogram))
    tilt = tilts(histogram, goal)
    per = goal.select("source", "source_size", "target").withColumnRenamed("source", "of")
    tilt = tilt.select(F.col("source").alias("tilted"), "tilt", "scale")
    per = per.join(tilt, F.col("of").eqNullSafe(F.col("tilted"))).drop("tilted")
    saturated = F.when(F.col("target") <= 0, 0.0).otherwise(F.lit(MOST))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("tilt").isNull(), saturated).otherwise(
        F.least(F.lit(MOST), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(50.0)))))
    rates = histogram.join(per, F.col("source").eqNullSafe(F.col("of"))).select("source", "size", "n", rate.alias("rate"))
    copies = rates.groupBy("source").applyInPandas(_copies, "source string, size long, n long, rate double, base long, extra long")
    goals = per.select("of", "source_size", "target")
    copies = copies.join(goals, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # Documents of one source and size are ranked in bins of their hash; each bin hands on to
    # the next how many extra copies are left.
    h = F.xxhash64("doc_id")
    bins = F.greatest(F.lit(1), F.ceil(F.col("n") / RANK_ROWS)).cast("long")
    plan = saved(copies.withColumn("bins", bins)).withColumnsRenamed({"source": "of", "size": "of_size"})
    placed = each.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size"))).drop("of", "of_size")
    placed = placed.withColumn("hash", h).withColumn("bin", F.pmod("hash", F.col("bins")))
    many = placed.filter(F.col("bins") > 1).groupBy("source", "size", "bin").agg(F.count("*").alias("here"))
    earlier = Window.partitionBy("source", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = many.select(F.col("source").alias("of"), F.col("size").alias("of_size"), F.col("bin").alias("of_bin"), F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("start"))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size")) & (F.col("bin") == F.col("of_bin")), "left")
    rank = F.row_number().over(Window.partitionBy("source", "size", "bin").orderBy("hash", "doc_id")) + F.coalesce("start", F.lit(0))
    copies = F.col("base") + F.when(rank <= F.col("extra"), 1).otherwise(0)
    return placed.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame) -> DataFrame:
    """``documents`` with every row as often as the mix takes it, with all its columns.

    Rows that repeat an id get as many copies as the most of them.
    """
    counts = mixed(docs).groupBy("doc_id").agg(F.max("copies").alias("copies")).filter("copies > 0")
    out = docs.join(counts, docs["doc_id"].eqNullSafe(counts["doc_id"]))
    copy = F.explode(F.sequence(F.lit(1), counts["copies"].cast("int")))
    return out.select(*[docs[c] for c in docs.columns], copy.alias("a copy")).drop("a copy")


def query(spark, sf_dir):
    return mixed(table(spark, sf_dir, "documents")).drop("source", "rate", "copies")


SQL = None
