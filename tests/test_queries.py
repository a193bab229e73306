"""Every registered query against its DuckDB equivalent, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, duck, name):
    df = entry_points.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(map(str, ([_plain(v) for v in r] for r in df.select(*cols).collect())))
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted(map(str, ([_plain(r[i]) for i in order] for r in cur.fetchall())))
    assert got == want


def test_entry_is_the_flagship(spark):
    assert entry_points.entry(spark).columns[:3] == ["source_id", "ts_ns", "click_seq"]
