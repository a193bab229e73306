"""A training corpus from ``documents``: toxicity, exact copies, near copies, mix, tokens.

Every stage reads what its predecessor has written and returns the columns of documents, the
last one its token digests. ORACLE_SQL is None: SQL expresses neither the trained classifier
nor the tilted mix; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofleet.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from chronofleet.llm.common import drop_scratch, saved, scratch_mark, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold of the classifier trained on ``labels``."""
    scores = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=docs.columns, score="_toxicity")
    return scores.filter(F.col("_toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies.

    Rows without an id are linked with nothing and stay.
    """
    parts = ngram_join.ngram_components(docs)
    others = parts.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(others, docs["doc_id"] == others["_id"], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as their source's target takes."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes per document of the mix."""
    return bpe.default_tokenizer(spark).digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("source_mixing", mix),
    ("byte_bpe", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of the mix; working tables of a stage are deleted when its result is written."""
    docs, mark = table(spark, sf_dir, "documents"), scratch_mark()
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
        drop_scratch(keep=docs, since=mark)
    return docs
