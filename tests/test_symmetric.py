"""Symmetric trees: the split of every level against trying all, held-out error, early stopping, and a failing trainer."""

import logging

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataflow.operators import models, symmetric

NAMES = ["x0", "x1", "x2", "x3"]


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(1)
    n = 2000
    pdf = pd.DataFrame({c: np.round(r.normal(size=n), 2) for c in NAMES})
    pdf["t"] = np.sin(pdf.x0 * 2) + pdf.x1 * pdf.x2 + (pdf.x3 > 0.3) * 2 + r.normal(size=n) * 0.2
    pdf["g"] = [f"g{i % 40}" for i in range(n)]
    pdf["fold"] = [i % 40 % 2 for i in range(n)]
    return pdf, spark.createDataFrame(pdf).repartition(3)


def test_first_tree_is_the_best_of_all_splits(table):
    pdf, rows = table
    model = symmetric.fit(rows, NAMES, "t", 1, 3, rate=1.0, l2=1.0, feature_share=1.0)
    assert model.base == pytest.approx(pdf.t.mean()) and model.rounds == 1
    splits, values = model.trees[0]
    edges = [np.unique(q) for q in rows.approxQuantile(NAMES, [i / 32 for i in range(1, 32)], 0.005)]
    left, leaf = (pdf.t - model.base).to_numpy(), np.zeros(len(pdf), int)
    for d, (f, edge) in enumerate(splits):
        def worth(k, e, leaf=leaf):
            up = pdf[NAMES[k]].to_numpy() > e
            return sum(left[(leaf == m) & side].sum() ** 2 / (((leaf == m) & side).sum() + 1) for m in np.unique(leaf) for side in (up, ~up))
        every = {(k, e): worth(k, e) for k in range(4) for e in edges[k]}
        assert worth(f, edge) == pytest.approx(max(every.values()))
        leaf = leaf | ((pdf[NAMES[f]].to_numpy() > edge).astype(int) << d)
    for m in np.unique(leaf):
        assert values[m] == pytest.approx(left[leaf == m].sum() / ((leaf == m).sum() + 1))
    got = model.transform(rows).select("prediction", *NAMES).toPandas()
    assert sorted(got.prediction.round(6)) == sorted(np.round(model.base + np.array(values)[leaf], 6))


def test_two_learners_are_better_together(table):
    pdf, rows = table
    found = {k: models.trained(rows, NAMES, "t", "fold", "g", 2, (1,), 25, 3, kinds=(k,))[0].select("g", "x0", "x1", "t", F.col("oof").alias(k)).toPandas().sort_values(["g", "x0", "x1", "t"]).reset_index(drop=True) for k in ("gbt", "symmetric")}
    t = found["gbt"].t
    error = {k: float(np.sqrt(((v[k] - t) ** 2).mean())) for k, v in found.items()}
    blend = float(np.sqrt((((found["gbt"].gbt + found["symmetric"].symmetric) / 2 - t) ** 2).mean()))
    assert error["symmetric"] < 0.75 * t.std() and blend < max(error.values())


def test_boosting_stops_and_edges(spark, table):
    r = np.random.default_rng(2)
    noise = spark.createDataFrame(pd.DataFrame({"x": r.normal(size=300), "t": r.normal(size=300), "aside": np.arange(300) % 3 == 0}))
    assert symmetric.fit(noise, ["x"], "t", 30, 3, rate=0.5, aside="aside", patience=2).rounds < 10
    assert symmetric.fit(noise.filter("t > 99"), ["x"], "t", 3, 2) is None
    flat = symmetric.fit(noise.withColumn("x", F.lit(1.0)), ["x"], "t", 2, 2)
    assert flat.transform(noise.withColumn("x", F.lit(1.0))).agg(F.stddev_pop("prediction")).first()[0] == pytest.approx(0, abs=1e-9)


def test_a_failing_trainer_is_replaced(table, caplog, monkeypatch):
    from pyspark.errors import PySparkException

    _, rows = table

    def fail(*a, **k):
        raise PySparkException("no trees today")

    monkeypatch.setattr(symmetric, "fit", fail)
    with caplog.at_level(logging.WARNING):
        out, test = models.trained(rows, NAMES, "t", "fold", "g", 2, (1,), 3, 2, rows.limit(5), kinds=("symmetric",))
    assert out.agg(F.max(F.abs("oof"))).first()[0] == 0 and test.count() == 5 and "no trees today" in caplog.text
