"""Exact quantiles by narrowing bins, and windows of one group over many ranges."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataflow.functions.ordered import Order, rolling, stepwise
from strataflow.operators import halo, quantiles


@pytest.mark.parametrize("kind", ["normal", "wide", "ties", "close", "signs", "tiny", "two"])
def test_quantiles_are_numpys(spark, kind):
    r = np.random.default_rng(7)
    v = {
        "normal": r.normal(size=3000),
        "wide": np.concatenate([10.0 ** r.uniform(-300, 300, 800), -(10.0 ** r.uniform(-300, 300, 800))]),
        "ties": np.concatenate([np.full(2000, 3.25), r.normal(size=50), np.full(900, -1.0)]),
        "close": 1.0 + np.arange(2000) * np.finfo(float).eps,
        "signs": np.array([-0.0, 0.0, -5e-324, 5e-324, -1.7e308, 1.7e308, 1.0]),
        "tiny": np.array([5e-324 * k for k in range(1, 400)] + [1.0]),
        "two": np.array([2.0, 4.0]),
    }[kind]
    shares = [0.0, 0.003, 0.25, 0.5, 0.9, 0.997, 1.0]
    rows = spark.createDataFrame(pd.DataFrame({"v": v})).repartition(3)
    got = quantiles.quantiles(rows, "v", shares)
    s = np.sort(v)
    for q, x in zip(shares, got, strict=True):
        at = q * (len(s) - 1)
        a, b = s[math.floor(at)], s[min(math.floor(at) + 1, len(s) - 1)]
        assert x == a + (b - a) * (at - math.floor(at)) or (math.isinf(b - a) and math.isinf(x))


def test_passes_are_few(spark, monkeypatch):
    seen = []
    kept = quantiles.Bracket
    monkeypatch.setattr(quantiles, "Bracket", lambda *a, **k: (seen.append(a[:3]), kept(*a, **k))[1])
    r = np.random.default_rng(3)
    values = spark.createDataFrame(pd.DataFrame({"v": r.lognormal(sigma=8, size=20_000)}))
    assert quantiles.order_statistics(values, "v", [10_000])[10_000] == np.sort(values.toPandas().v)[10_000]
    assert len(seen) <= 4


def test_quantiles_of_nothing(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "v double")
    assert quantiles.quantiles(rows, "v", [0.5, 0.1]) == [None, None]
    assert quantiles.quantiles(rows.unionByName(spark.createDataFrame([(7.0,)], "v double")), "v", [0.5]) == [7.0]
    with pytest.raises(ValueError):
        quantiles.order_statistics(rows.filter("v > 1e9 and v < 0"), "v", [0])


def test_one_large_well_is_spread_over_tasks(spark):
    n, size = 60_000, 4096
    h = F.xxhash64("row_id")
    rows = spark.range(0, n, 1, 16).select(F.lit("w").alias("well_id"), F.col("id").alias("row_id"), (h % 1000 / 7.0).alias("v"), F.when(h % 5 < 2, (h % 977).cast("double")).alias("g"), (F.col("id") * 2 + (h % 2)).cast("double").alias("md"))
    order = Order(("well_id",), ("row_id",))
    features = {"mean": lambda o: rolling(F.col("v"), o.centered(101), "mean"), "std": lambda o: rolling(F.col("v"), o.trailing(31), "std"), "slope": lambda o: stepwise(F.col("v"), F.col("md"), o), "ahead": lambda o: F.lead("v", 40).over(o.window)}
    cut = halo.windowed(halo.carried(rows, order, ["g"], ["g"], ["v"], size), order, features, 50, 50, size)
    assert cut.select(F.spark_partition_id()).distinct().count() > 1
    whole = rows.withColumns({k: f(order) for k, f in features.items()} | {"filled": F.coalesce(F.last("g", True).over(order.so_far), F.first("g", True).over(order.whole)), "sum": F.sum("v").over(order.so_far)})
    both = cut.withColumn("filled", F.coalesce("last_g", "next_g")).alias("a").join(whole.alias("b"), "row_id")
    close = lambda c, d=None: (F.abs(F.col(f"a.{c}") - F.col(f"b.{d or c}")) < 1e-6) | (F.col(f"a.{c}").isNull() & F.col(f"b.{d or c}").isNull())
    counts = both.agg(F.count("*").alias("n"), *(F.count_if(close(c)).alias(c) for c in (*features, "filled")), F.count_if(close("sum_v", "sum")).alias("sum")).first().asDict()
    assert set(counts.values()) == {n}


def test_halos_wider_than_ranges_and_gaps(spark):
    pdf = pd.DataFrame([(w, i, float(i * i % 17) if i % 11 > 6 else None) for w, n in (("a", 40), ("b", 1), ("c", 9)) for i in range(n)], columns=["well_id", "row_id", "v"])
    rows = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None)))
    order = Order(("well_id",), ("row_id",))
    got = halo.windowed(halo.carried(rows, order, ["v"], ["v"], ["v"], 3), order, {"m": lambda o: F.sum("v").over(o.centered(15))}, 7, 7, 3).toPandas().set_index(["well_id", "row_id"]).sort_index()
    want = rows.withColumns({"m": F.sum("v").over(order.centered(15)), "last": F.last("v", True).over(order.so_far), "next": F.first("v", True).over(order.onward), "s": F.coalesce(F.sum("v").over(order.so_far), F.lit(0.0))}).toPandas().set_index(["well_id", "row_id"]).sort_index()
    for a, b in (("m", "m"), ("last_v", "last"), ("next_v", "next"), ("sum_v", "s")):
        np.testing.assert_array_equal(got[a], want[b])


def test_numbers_by_ranges(spark):
    pdf = pd.DataFrame({"k": [5.0] * 300 + [None] * 20 + list(np.random.default_rng(1).normal(size=700)), "t": range(1020)})
    rows = spark.createDataFrame(pdf).withColumn("k", F.nanvl("k", F.lit(None)))
    got = halo.numbered(rows, "k", ["t"], "place", 50).toPandas()
    assert sorted(got.place) == list(range(1020))
    ordered = got.sort_values("place")
    want = pd.concat([pdf[pdf.k.isna()].sort_values("t"), pdf[pdf.k.notna()].sort_values(["k", "t"])])
    assert ordered.t.tolist() == want.t.tolist()
    assert halo.numbered(rows.limit(0), "k", ["t"]).count() == 0
