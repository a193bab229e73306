"""Registered queries and their DuckDB equivalents, grouped like the operators."""

from __future__ import annotations

from chronofleet.registry import catalogs, events, ingest, ranges, series, spatial

GROUPS = (ranges, series, spatial, catalogs, events, ingest)


def all_queries():
    out = {}
    for g in GROUPS:
        clash = out.keys() & g.QUERIES.keys()
        if clash:
            raise ValueError(f"query names repeat: {sorted(clash)}")
        out.update(g.QUERIES)
    return out
