"""Column rules and the residual pipeline."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import DATA
from strataflow.functions.scalar import offset_name
from strataflow.operators import alignment, columns, description, models
from strataflow.plans import queries_models, residual
from strataflow.plans.wellview import WELL, wells


def test_column_rules(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "x", 3.0, True)], "id int, gr_mean double, name string, gr_std double, flag boolean")
    assert columns.chosen(df) == ["id", "gr_mean", "gr_std", "flag"]
    assert columns.chosen(df, names=["flag", "name"], prefixes=["gr_"], excluded=["gr_std"]) == ["gr_mean", "flag"]
    assert columns.chosen(df, suffixes=["_std"]) == ["gr_std"]
    with pytest.raises(ValueError):
        columns.chosen(df, most=2)
    assert columns.common(df, df.drop("flag"), ["flag", "id"]) == ["id"]
    assert columns.aligned(df, ["gr_mean", "new"]).first().asDict() == {"gr_mean": 2.0, "new": 0.0}
    with pytest.raises(ValueError):
        columns.aligned(df, ["new"], fill=None)
    assert columns.without_groups(["a_1", "b_1", "a_2"], ["a_"]) == (["b_1"], {"a_": 2})
    columns.write_summary({"overall_auc": 0.5}, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"overall_auc": 0.5}


def test_residual_pipeline_fills_the_template(spark):
    got = queries_models.residual_pipeline(spark, DATA)
    hidden = wells(spark, DATA).filter("tvt_input is null and cast(well_id as bigint) % 10 = 0").select(F.concat_ws("_", "well_id", "row_id").alias("id"), "tvt", "row_id", "well_id")
    pdf, want = got.toPandas().set_index("id"), hidden.toPandas().set_index("id")
    assert set(pdf.index) == set(want.index) and sorted(pdf.place) == list(range(len(want))) and np.isfinite(pdf.tvt).all()
    placed = want.assign(place=pdf.place).sort_values("place")
    assert placed.reset_index().equals(placed.reset_index().sort_values(["well_id", "row_id"]).reset_index(drop=True))


def test_out_of_fold_models_beat_the_anchor(spark):
    got = queries_models.gbt_oof(spark, DATA).toPandas()
    assert np.sqrt(((got.oof - got.target) ** 2).mean()) < np.sqrt((got.target**2).mean())


def test_surfaces_come_from_other_wells(spark):
    rows = wells(spark, DATA)
    got = residual.surfaced(rows, WELL).toPandas().set_index(["well_id", "row_id"])
    pdf = rows.toPandas()
    known = pdf[pdf.tvt_input.notna()].assign(s=lambda d: d.tvt_input + d.z)
    medians = known.groupby("well_id").agg(x=("x", "median"), y=("y", "median"), s=("s", lambda v: np.percentile(v, 10)))
    sx, sy = (medians[c].std(ddof=0) for c in "xy")
    for key in list(got.index)[:: max(1, len(got) // 7)]:
        row = got.loc[key]
        others = medians.drop(key[0], errors="ignore")
        d = np.hypot((others.x - row.x) / sx, (others.y - row.y) / sy)
        assert row.knn_distance == pytest.approx(d.min())
        samples = pd.concat([g.sort_values("row_id").iloc[np.unique(np.linspace(0, len(g) - 1, min(60, len(g)), dtype=int))] for w, g in known.groupby("well_id") if w != key[0]])
        dd = np.hypot((samples.x - row.x) / sx, (samples.y - row.y) / sy).to_numpy()
        near = np.argsort(dd)[:20]
        w = 1 / (dd[near] + 1e-3)
        if np.sort(dd)[20] > np.sort(dd)[19]:  # else the twentieth is one of several
            assert row.dense == pytest.approx((w * samples.s.to_numpy()[near]).sum() / w.sum())
    # what a well says of itself does not reach its own rows
    one = pdf.well_id.iloc[0]
    moved = rows.withColumn("tvt_input", F.when(F.col("well_id") == one, F.col("tvt_input") + 1000).otherwise(F.col("tvt_input")))
    again = residual.surfaced(moved, WELL).toPandas().set_index(["well_id", "row_id"])
    assert np.allclose(got.loc[one, "dense"], again.loc[one, "dense"]) and not np.allclose(got["dense"], again.loc[got.index, "dense"])


def test_description_of_a_well():
    assert len(description.names()) > 180
    n, k = 60, 25
    md = np.arange(n) * 2.0
    rows = pd.DataFrame({"well_id": "a", "row_id": range(n), "md": md, "z": md / 10, "gr": np.sin(md / 5), "tvt_input": [*(5 + md[:k] * 0.5), *[np.nan] * (n - k)], **{c: md * 0.6 + 5 for c in description.MORE}})
    depth = np.arange(0, 100.0)
    well = alignment.Well(rows, pd.DataFrame({"ctvt": depth, "cgr": 3 * depth}))
    found = description.described(well)
    assert found["slope_all"] == pytest.approx(0.5) and found["known_rows"] == k
    np.testing.assert_allclose(found["ahead_all_d"], 0.5 * (md[k:] - md[k - 1]))
    np.testing.assert_allclose(found["s0_all_d"] + well.last, 5 + 0.5 * md[k:])  # the surface is known + z
    np.testing.assert_allclose(found["anchor_diff_p5"], np.sin(md[k:] / 5) - 3 * (well.last + 5))
    straight = np.abs(np.stack([found[f"straight_{offset_name(o)}"] for o in alignment.STRAIGHT]))
    np.testing.assert_allclose(found["straight_least"], straight.min(0))
    np.testing.assert_allclose(found["straight_gap"], np.sort(straight, 0)[1] - straight.min(0))
    assert description.affine(np.arange(30.0) * 2 + 1, np.arange(30.0)) == (pytest.approx(2), pytest.approx(1)) and description.affine(np.ones(3), np.zeros(3)) == (1.0, 1.0)
    b = description.offsets(np.arange(90.0))
    assert (b["all"], b["early"], b["mid"], b["late"]) == (44.5, 14.5, 44.5, 64.5) and b["weighted"] > 44.5


def test_trained_models_stop_early_and_fall_back(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": [f"g{i % 16}" for i in range(800)], "fold": [i % 16 % 2 for i in range(800)], "x": rng.normal(size=800)})
    pdf["t"] = 3 * pdf.x + rng.normal(size=800) * 0.1
    rows = spark.createDataFrame(pdf).cache()
    out, test = models.trained(rows, ["x"], "t", "fold", "g", 2, (1,), 40, 2, rows.limit(50), kinds=("gbt",))
    got = out.toPandas()
    assert len(got) == 800 and np.sqrt(((got.oof - got.t) ** 2).mean()) < 0.3 * got.t.std()
    assert test.count() == 50 and {"oof"} <= set(test.columns)
    none, _ = models.trained(rows.limit(0), ["x"], "t", "fold", "g", 2, (1,), 5, 2)
    assert none.count() == 0
    g = models.blend_weights(rows.withColumn("bad", F.lit(100.0)), ["x", "bad"], "t")
    assert abs(g[0] - 3) < 0.2 and g[1] < 0.01
