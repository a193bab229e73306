"""The registered query of every operator here, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from chronofleet.llm import bpe, exact_dedup, hnsw_dedup, mixing, ngram_join, quality, source_audit, suffix_dedup, surrogates, topk_search, toxicity, warc, whitening

QUERIES = {
    "op1_ngram_join": ngram_join,
    "op2_exact_dedup": exact_dedup,
    "op3_byte_bpe": bpe,
    "op4_hnsw_dedup": hnsw_dedup,
    "op5_quality": quality,
    "op6_source_mixing": mixing,
    "op7_surrogates": surrogates,
    "op8_warc": warc,
    "op9_suffix_dedup": suffix_dedup,
    "op10_toxicity": toxicity,
    "op11_source_audit": source_audit,
    "op12_topk_search": topk_search,
    "op13_whitening": whitening,
}


def queries():
    return {name: module.query for name, module in QUERIES.items()}


def oracle_sql():
    return {name: module.SQL for name, module in QUERIES.items() if module.SQL is not None}
