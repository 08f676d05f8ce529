import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from revloom.plans import order, quantiles, runtime, skew
from tests.conftest import rows


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most rows; few partitions more than keys, so blocks cut the hot key."""
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(4)}", rng.randrange(50), i,
             rng.randrange(1, 9)) for i in range(3000)]
    return data, spark.createDataFrame(data, "k string, v int, id int, w long").repartition(7)


def test_positions_and_running_totals(spark, hot, monkeypatch):
    data, df = hot
    # keep small range partitions apart, so that the carry between blocks is exercised
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = order.with_position(df, ["k"], [F.col("v").asc(), F.col("id").desc()], ["w"])
        got = {r.id: (r.position, r.running_w) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for key in {d[0] for d in data}:
        total = 0
        for place, d in enumerate(sorted((d for d in data if d[0] == key),
                                         key=lambda d: (d[1], -d[2])), 1):
            total += d[3]
            want[d[2]] = (place, total)
    assert got == want


def test_carry_last(spark, hot):
    data, df = hot
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sparse = df.withColumn("x", F.when(F.col("id") % 40 == 0, F.col("id")))
        found = order.carry_last(sparse, ["k"], [F.col("id").asc()], "x", "last")
        got = {r.id: r["last"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    latest, want = {}, {}
    for k, _, i, _ in sorted(data, key=lambda d: d[2]):
        if i % 40 == 0:
            latest[k] = i
        want[i] = latest.get(k)
    assert got == want


def test_running_sum_over_segments(spark, monkeypatch):
    monkeypatch.setattr(order, "SEGMENT", 4)
    df = spark.createDataFrame([("a", i, i * i) for i in range(1, 30)], "k string, p long, v long")
    got = {r.p: r.s for r in order.running_sum(df, ["k"], "p", "v", "s").collect()}
    assert got == {i: sum(j * j for j in range(1, i + 1)) for i in range(1, 30)}


def test_exact_quantiles(spark, hot):
    data, df = hot
    probs = {"q25": 0.25, "q50": 0.5, "q93": 0.93, "top": 1.0}
    for fn in (quantiles.exact_quantiles, quantiles.count_quantiles):
        for r in fn(df, ["k"], "v", probs).collect():
            values = [d[1] for d in data if d[0] == r.k]
            for name, p in probs.items():
                assert r[name] == pytest.approx(np.quantile(values, p))


@pytest.mark.parametrize("n", [3, 1500])
def test_top_n(hot, n):
    data, df = hot
    got = rows(skew.top_n(df, ["k"], [F.col("v").desc(), F.col("id").asc()], n, ["id"]), "id")
    want = []
    for key in {d[0] for d in data}:
        want += [(d[2],) for d in sorted((d for d in data if d[0] == key),
                                         key=lambda d: (-d[1], d[2]))[:n]]
    assert got == sorted(want, key=lambda r: (False, str(r[0])))


@pytest.mark.parametrize("limit", [0, 1000])
def test_attach(spark, hot, limit):
    data, df = hot
    tops = df.groupBy("k").agg(F.max("v").alias("top")).filter(F.col("k") != "k0")
    for found in (skew.attach(df, tops, ["k"], ["id"]),
                  skew.attach_measured(df, tops, ["k"], ["id"], limit)):
        assert found.count() == len(data)
        for r in found.groupBy("k").agg(F.min("top").alias("a"), F.max("top").alias("b")).collect():
            want = None if r.k == "k0" else max(d[1] for d in data if d[0] == r.k)
            assert (r.a, r.b) == (want, want)


def test_scratch_root_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    root = runtime.scratch_root(spark)
    if configured:
        assert root == configured
    settled = runtime.settle(spark.range(5))
    assert settled.count() == 5
    assert root.rstrip("/") in settled.inputFiles()[0]


def test_positions_need_no_window_over_rows(spark):
    df = spark.createDataFrame([(k, i) for k in "ab" for i in range(50)] + [("c", 7)], "k string, v long")
    found = order.with_position(df, ["k"], [F.col("v").desc()])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "Window" not in plan  # the blocks' totals are settled
    expected = [(k, i, 50 - i) for k in "ab" for i in range(50)] + [("c", 7, 1)]
    assert sorted(tuple(r) for r in found.select("k", "v", "position").collect()) == sorted(expected)
