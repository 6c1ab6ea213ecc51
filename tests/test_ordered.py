"""Window expressions against pandas on random gaps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataflow.functions.ordered import Order, fill, gradient, interpolate, lag_filled, lead_filled, rolling, unwrapped, wrapped
from strataflow.functions.scalar import clip, finite, offset_name, safe_divide

O = Order(("k",), ("i",))


def frame(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(12):
        n = int(rng.integers(1, 25))
        v = np.where(rng.random(n) < 0.4, np.nan, rng.normal(0, 10, n).round(3))
        if k == 0:
            v[:] = np.nan
        rows += [(k, i, None if np.isnan(v[i]) else float(v[i]), float(i + rng.random())) for i in range(n)]
    pdf = pd.DataFrame(rows, columns=["k", "i", "v", "x"]).astype({"v": float})
    return spark.createDataFrame(rows, "k int, i int, v double, x double"), pdf


@pytest.mark.parametrize("seed", range(3))
def test_fills_and_windows(spark, seed):
    df, pdf = frame(spark, seed)
    v = F.col("v")
    got = df.select("k", "i", fill(v, O).alias("fill"), interpolate(v, O, F.col("i")).alias("interp"), lag_filled(v, O, 2).alias("lag"), lead_filled(v, O, 2).alias("lead"), rolling(v, O.centered(5), "mean").alias("mean"), rolling(v, O.trailing(4), "std").alias("std")).toPandas().sort_values(["k", "i"]).reset_index(drop=True)
    g = pdf.groupby("k")["v"]
    want = pd.DataFrame({
        "fill": g.transform(lambda s: s.ffill().bfill()),
        "interp": g.transform(lambda s: s.interpolate(limit_direction="both")),
        "mean": g.transform(lambda s: s.rolling(5, center=True, min_periods=1).mean()),
        "std": g.transform(lambda s: s.rolling(4, min_periods=2).std()),
    })
    for c in want:
        np.testing.assert_allclose(got[c].astype(float), want[c], atol=1e-9, err_msg=c)


def test_gradient_is_numpys(spark):
    df, pdf = frame(spark, 5)
    pdf["y"] = np.sin(pdf["x"])
    rows = spark.createDataFrame(pdf[["k", "i", "x", "y"]])
    got = rows.select("k", "i", gradient(F.col("y"), F.col("x"), O).alias("g")).toPandas().sort_values(["k", "i"])["g"].to_numpy()
    want = np.concatenate([np.gradient(p["y"], p["x"]) if len(p) > 1 else [0.0] for _, p in pdf.groupby("k")])
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_unwrap_is_numpys(spark):
    angles = np.array([0.0, 2.5, -2.5, 3.1, -3.1, 0.4, np.pi, -np.pi, 3.0])
    df = spark.createDataFrame([(1, i, float(a)) for i, a in enumerate(angles)], "k int, i int, a double")
    step = F.col("a") - F.lag("a").over(O.window)
    got = df.withColumn("s", step).select("i", unwrapped(F.col("s"), F.col("a"), O).alias("u")).orderBy("i").toPandas()["u"]
    np.testing.assert_allclose(got, np.unwrap(angles), atol=1e-12)
    assert df.select(wrapped(F.lit(np.pi)).alias("w")).first()["w"] == pytest.approx(np.pi)


def test_scalars(spark):
    row = spark.range(1).select(clip(F.lit(None).cast("double"), 0, 1).alias("a"), clip(F.lit(5.0), 0, 1).alias("b"), finite(F.lit(float("inf"))).alias("c"), finite(F.lit(float("nan"))).alias("d"), safe_divide(F.lit(1.0), F.lit(0.0)).alias("e")).first()
    assert tuple(row) == (None, 1.0, None, None, None)
    assert offset_name(5) == "p5" and offset_name(-10) == "m10"
    with pytest.raises(ValueError):
        O.centered(4)
