"""Neighbours over many cells, and what moves for them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import DATA
from strataflow.operators import spatial
from strataflow.plans import residual
from strataflow.plans.wellview import WELL, curve, wells


@pytest.fixture
def given(monkeypatch):
    """How many rows each pass over cells gives."""
    seen, best = [], spatial._best

    def counted(*a):
        out = best(*a).cache()
        seen.append(out.count())
        return out

    monkeypatch.setattr(spatial, "_best", counted)
    return seen


def test_queries_far_from_the_points(spark, given):
    """Points crowd near the origin, queries lie far outside: the distance found at home spans all cells."""
    rng = np.random.default_rng(4)
    p = pd.DataFrame({"pid": range(900), "own": np.arange(900) % 40, "x": rng.normal(size=900), "y": rng.normal(size=900), "value": rng.normal(size=900)})
    p.loc[:30, ["x", "y"]] = 0.25  # many at one place
    q = pd.DataFrame({"qid": range(120), "own": np.arange(120) % 40, "x": rng.normal(size=120) * 9, "y": rng.normal(size=120) * 9})
    q.loc[:9, ["x", "y"]] = 0.25
    got = spatial.nearest(spark.createDataFrame(q), spark.createDataFrame(p), 5, cell=25).toPandas().set_index("qid")
    for r in q.itertuples():
        others = p[p.own != r.own]
        d = np.sqrt((others.x - r.x) ** 2 + (others.y - r.y) ** 2)
        want = others.assign(d=d).sort_values(["d", "pid"]).pid[:5].tolist()
        assert [n["pid"] for n in got.loc[r.qid, "neighbours"]] == want
    assert given[0] <= 120 * 5 and given[1] < 120 * 5  # each cell within the span gave five for each query before


def test_parts_of_queries_do_not_part_the_points(spark, given, monkeypatch):
    """Points repeated for each part of the queries were counted as points, so queries were repeated for parts of them."""
    monkeypatch.setattr(spatial, "QUERIES", 50)
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"pid": range(3000), "x": rng.normal(size=3000), "y": rng.normal(size=3000), "value": 1.0})
    points = spark.createDataFrame(p)
    got = spatial.nearest(points.select(F.col("pid").alias("qid"), "x", "y"), points, 3).toPandas().set_index("qid")
    assert given == [9000]
    for q in (0, 7, 2999):
        d = np.hypot(p.x - p.x[q], p.y - p.y[q]).drop(q)
        assert [n["pid"] for n in got.loc[q, "neighbours"]] == d.sort_values().index[:3].tolist()


def test_a_point_is_enough_where_few_are_at_home(spark):
    """Queries whose own cell holds fewer than k points of other groups ask every cell."""
    p = pd.DataFrame({"pid": range(64), "own": np.arange(64) // 16, "x": np.arange(64.0), "y": np.zeros(64), "value": 1.0})
    q = p.drop(columns="value").rename(columns={"pid": "qid"})
    got = spatial.nearest(spark.createDataFrame(q), spark.createDataFrame(p), 20, cell=4).toPandas().set_index("qid")
    for r in q.itertuples():
        others = p[p.own != r.own]
        assert [n["pid"] for n in got.loc[r.qid, "neighbours"]] == others.assign(d=(others.x - r.x).abs()).sort_values(["d", "pid"]).pid[:20].tolist()


def test_rows_of_all_features_are_not_moved(spark):
    rows, names = residual.full_features(wells(spark, DATA), curve(spark, DATA), WELL)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and len(names) > 300
    assert not any("Join" in line or "Exchange" in line for line in plan[: plan.index("FlatMapCoGroupsInPandas")].splitlines())
    assert rows.filter(F.col("target").isNull()).count() == 0 and rows.count() == rows.select("well_id", "row_id").distinct().count()


def test_folds_reach_the_rows_without_moving_them(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = wells(spark, DATA).select("well_id", "row_id")
        found = residual.with_folds(rows, wells(spark, DATA), "well_id", 3)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(residual, "BROADCAST_WELLS", 0)
        assert sorted(found.collect()) == sorted(residual.with_folds(rows, wells(spark, DATA), "well_id", 3).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
