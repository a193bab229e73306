"""Split scans must equal plain scans, whatever the shape of the data."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronofleet.operators.ranges import asof_join
from chronofleet.plans.histogram import time_histogram
from chronofleet.plans.scan import OrderedScan

SCHEMA = "s string, ts_ns bigint, seq bigint, value double"
T0 = 1_704_067_200_000_000_000


def _shapes():
    rng = random.Random(5)
    value = lambda: rng.choice([None, float("nan"), rng.randint(-9, 9) / 2])
    even = [("a", T0 + i * 10, i, value()) for i in range(300)]
    one_time = [("a", T0, i, value()) for i in range(300)]
    outlier = [("a", 0, 0, 1.0)] + [("a", T0 + rng.randint(0, 500), i, value()) for i in range(1, 300)]
    negative = [("a", -rng.randint(0, 2**40), i, value()) for i in range(200)] + [("b", 5, 0, 2.0)]
    mixed = even + [("b", T0 + 7 * (i // 90), i, value()) for i in range(280)] + [("c", T0, 1, 3.0)]
    bimodal = [("a", rng.choice([1, 2**60]) + rng.randint(0, 3), i, value()) for i in range(400)]
    return {"even": even, "one_time": one_time, "outlier": outlier, "negative": negative, "mixed": mixed, "bimodal": bimodal}


def _scan(df, target):
    scan = OrderedScan(df, ["s"], target_rows=target)
    scan.lag("p", F.struct("seq")).lead("n", F.struct("seq")).fill("f", F.when(~F.isnan("value"), F.col("value")))
    scan.rank("r").running_sum("t", F.col("seq")).max_before("m", F.col("seq") % 17)
    return scan


@pytest.mark.parametrize("shape", _shapes())
def test_split_equals_plain(spark, rows, shape):
    df = spark.createDataFrame(_shapes()[shape], SCHEMA).repartition(5)
    plain, split = _scan(df, 10**6), _scan(df, 7)
    want, got = rows(plain.run().drop("value")), rows(split.run().drop("value"))
    assert not plain._hot and split._hot
    assert got == want
    w = Window.partitionBy("s").orderBy("ts_ns", "seq")
    check = split.run().withColumn("r0", F.row_number().over(w)).withColumn("t0", F.sum("seq").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert check.filter((F.col("r") != F.col("r0")) | (F.col("t") != F.col("t0"))).isEmpty()


@pytest.mark.parametrize("shape", ["one_time", "mixed", "bimodal"])
def test_no_cell_holds_a_hot_series(spark, shape):
    data = _shapes()[shape]
    df = spark.createDataFrame(data, SCHEMA).withColumn("seq", F.shiftleft("seq", 14))
    kept = _scan(df, 20).run(keep=True)
    largest = kept.filter(F.col("_cell").isNotNull()).groupBy("s", "_cell", "_tie").count().agg(F.max("count")).first()[0]
    assert largest <= 20


def test_a_hot_series_without_a_key_is_cut_too(spark, rows):
    rng = random.Random(8)
    data = [(None, T0 + rng.randint(0, 10**7), i, float(i)) for i in range(300)] + [("a", T0 + i, i, 1.0) for i in range(50)] + [(None, T0 + 5, 400 + i, 2.0) for i in range(60)]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    split = _scan(df, 20).run(keep=True)
    assert rows(split.drop("value", "_cell", "_tie")) == rows(_scan(df, 10**6).run().drop("value"))
    assert "NestedLoop" not in split._jdf.queryExecution().executedPlan().toString()
    assert split.filter("s IS NULL").groupBy("_cell", "_tie").count().agg(F.max("count")).first()[0] <= 60


def test_stored_histogram_cuts_like_a_count(spark, rows):
    rng = random.Random(3)
    step = 1 << 36
    data = [("a", T0 + int(rng.gauss(0, 40)) * step + rng.randint(0, step - 1), i, float(i)) for i in range(1500)]
    data += [("b", T0 + rng.choice([0, 900]) * step + i, i, float(i)) for i in range(500)] + [("c", -step * 3 + i, i, 0.0) for i in range(5)]
    df = spark.createDataFrame(data, SCHEMA)
    stored = time_histogram(df, ["s"]).union(time_histogram(df.limit(0), ["s"]))
    make = lambda h: OrderedScan(df, ["s"], target_rows=40, histogram=h).lag("p", F.struct("seq")).rank("r").running_sum("t", F.col("seq"))
    kept = make(stored).run(keep=True)
    largest = kept.filter(F.col("_cell").isNotNull()).groupBy("s", "_cell", "_tie").count().agg(F.max("count")).first()[0]
    assert largest <= 40
    want = rows(OrderedScan(df, ["s"]).lag("p", F.struct("seq")).rank("r").running_sum("t", F.col("seq")).run(), "s", "seq", "r", "t")
    assert rows(kept, "s", "seq", "r", "t") == want == rows(make(None).run(), "s", "seq", "r", "t")
    # The histogram of more rows than the frame has cuts as well.
    some = df.filter("seq % 3 = 0")
    few = OrderedScan(some, ["s"], target_rows=40, histogram=stored).rank("r").run()
    assert rows(few, "s", "seq", "r") == rows(OrderedScan(some, ["s"]).rank("r").run(), "s", "seq", "r")


def test_keys_of_any_name(spark, rows):
    df = spark.createDataFrame([(s, T0 + i * 10**8, i, 1.0) for s in "ab" for i in range(100)], SCHEMA)
    for name in ("n", "lo", "slice", "level", "at", "ts"):
        named = df.withColumnRenamed("s", name)
        make = lambda target: OrderedScan(named, [name], target_rows=target).rank("r").run()  # noqa: B023, E731
        assert rows(make(9), name, "seq", "r") == rows(make(10**6), name, "seq", "r")


def test_struct_sequence(spark, rows):
    data = [("a", T0, ("f1", i), float(i)) for i in range(50)] + [("a", T0, ("f0", i << 17), float(i)) for i in range(50)]
    df = spark.createDataFrame(data, "s string, ts_ns bigint, seq struct<file:string,row:bigint>, value double")
    make = lambda target: OrderedScan(df, ["s"], target_rows=target).lag("p", F.col("value")).rank("r").run().select("r", "value", "p.v")
    assert rows(make(5)) == rows(make(10**6))


def test_chained_scan_reuses_cells(spark, rows):
    df = spark.createDataFrame(_shapes()["mixed"], SCHEMA)

    def chain(target):
        first = OrderedScan(df, ["s"], target_rows=target).rank("r")
        mid = first.run(keep=True)
        return OrderedScan(mid, ["s"], like=first).running_sum("t", F.col("r")).run().select("s", "ts_ns", "seq", "r", "t")

    out = chain(9)
    assert "_cell" not in out.columns
    assert rows(out) == rows(chain(10**6))


def test_global_scan_without_key(spark, rows):
    df = spark.createDataFrame(_shapes()["even"], SCHEMA)
    assert rows(OrderedScan(df, [], target_rows=11).rank("r").run(), "r") == [(i,) for i in range(1, 301)]


@pytest.mark.parametrize("shape", ["even", "one_time", "outlier", "mixed"])
def test_asof_equals_brute_force(spark, rows, shape):
    rng = random.Random(2)
    right = _shapes()[shape]
    times = sorted({r[1] for r in right})
    left = [(rng.choice(["a", "b", "z"]), rng.choice(times) + rng.randint(-6, 6), i) for i in range(150)]
    left += [("a", times[-1], 1000 + i) for i in range(60)]
    r = spark.createDataFrame(right, SCHEMA)
    out = asof_join(spark.createDataFrame(left, "s string, ts_ns bigint, id bigint"), r, ["s"], values=["seq"], tolerance_ns=400, target_rows=8)
    want = []
    for s, t, i in left:
        best = max(((ts, q) for s2, ts, q, _ in right if s2 == s and ts <= t), default=None)
        if best is not None and t - best[0] > 400:
            best = None
        want.append((i, None if best is None else best[0], None if best is None else best[1]))
    assert rows(out, "id", "right_ts_ns", "right_seq") == sorted(want, key=lambda x: x[0])
