"""Connected components of a graph of links, by alternating stars on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofleet.llm.common import saved


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; a component is named by its smallest node.

    Large-star and small-star steps hook every neighbour to the smallest one around it. A node
    with any number of links is a join key whose rows can be split, never a group in one task.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    pairs = saved(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        # Large star: every larger neighbour of a node hooks to the smallest node around it.
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        pairs = both.join(low, F.col("u") == F.col("c")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours hook to the smallest of them.
        low = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        hooked = pairs.join(low, F.col("u") == F.col("c"))
        pairs = hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("c").alias("u"), F.col("m").alias("v")))
        pairs = saved(pairs.filter("u <> v").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = now
