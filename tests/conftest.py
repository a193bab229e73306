from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from chronofleet.session import configure


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("chronofleet-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples, NaN shown as text so that it compares."""

    def get(df, *cols):
        picked = df.select(*cols) if cols else df

        def plain(v):
            if isinstance(v, float) and v != v:
                return "nan"
            return v

        return sorted((tuple(plain(v) for v in r) for r in picked.collect()), key=lambda r: [(v is None, str(type(v)), v) if not isinstance(v, (dict, list)) else (False, "", str(v)) for v in r])

    return get


@pytest.fixture
def series(spark):
    """Samples from ``{channel: [(ts, value), ...]}`` of one source, in list order."""

    def make(channels, source="log"):
        data = []
        for c, points in channels.items():
            data += [(source, c, ts, i, None if v is None else float(v)) for i, (ts, v) in enumerate(points)]
        return spark.createDataFrame(data, "source_id string, channel_id string, ts_ns bigint, seq bigint, value double")

    return make
