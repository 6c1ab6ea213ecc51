"""Table functions called from SQL against the DataFrame forms; model queries by what their rows must be."""

import numpy as np
import pytest

from helpers import DATA
from strataflow.operators import table_functions
from strataflow.plans import registry
from strataflow.plans.wellview import curve, wells


def test_beams_by_sql(spark):
    table_functions.register(spark)
    sql = """SELECT * FROM beam_paths(TABLE(SELECT well_id, row_id, md, z, gr, tvt_input, CAST(NULL AS DOUBLE) AS ctvt, CAST(NULL AS DOUBLE) AS cgr FROM {wells}
 UNION ALL SELECT well_id, NULL, NULL, NULL, NULL, NULL, ctvt, cgr FROM {knots}) PARTITION BY (well_id))"""
    key = ["well_id", "row_id"]
    got = spark.sql(sql, wells=wells(spark, DATA), knots=curve(spark, DATA)).toPandas().set_index(key).sort_index()
    want = registry.QUERIES["beam_align"](spark, DATA).toPandas().set_index(key).sort_index()
    assert len(got) and got.index.equals(want.index)
    np.testing.assert_allclose(got[want.columns], want)


def test_functions_of_wells_without_curve_or_signal(spark):
    table_functions.register(spark)
    rows = spark.createDataFrame([("a", 0, 5.0, 1.0), ("a", 1, None, 1.0), ("b", 0, 5.0, 1.0)], "well_id string, row_id long, signal double, anchor double")
    knots = spark.createDataFrame([("a", 0.0, 0.0), ("a", 3.0, 6.0), ("c", 1.0, 2.0)], "well_id string, ctvt double, cgr double")
    sql = """SELECT * FROM curve_probes(TABLE(SELECT *, CAST(NULL AS DOUBLE) AS ctvt, CAST(NULL AS DOUBLE) AS cgr FROM {rows} UNION ALL SELECT well_id, NULL, NULL, NULL, ctvt, cgr FROM {knots}) PARTITION BY (well_id), array(0.0D, 99.0D))"""
    got = sorted(((r.well_id, r.row_id, r.off), r["diff"]) for r in spark.sql(sql, rows=rows, knots=knots).collect())
    assert got == [(("a", 0, 0.0), 3.0), (("a", 0, 99.0), -1.0), (("a", 1, 0.0), None), (("a", 1, 99.0), None), (("b", 0, 0.0), None), (("b", 0, 99.0), None)]
    grid = spark.sql("SELECT * FROM resampled(TABLE({knots}) PARTITION BY (well_id) ORDER BY (ctvt), 2.0D)", knots=knots).collect()
    assert sorted(map(tuple, grid)) == [("a", 0, 0.0, 0.0), ("a", 1, 2.0, 4.0), ("a", 2, 4.0, 6.0), ("c", 0, 1.0, 2.0)]


def test_drift_queries(spark):
    found = registry.QUERIES["drift_importance"](spark, DATA).toPandas()
    auc = registry.QUERIES["drift_auc"](spark, DATA).first()[0]
    assert 0 <= auc <= 1 and found.overall_auc.nunique() == 1 and found.overall_auc[0] == pytest.approx(auc, abs=0.2)
    assert found.importance.sum() == pytest.approx(1) and (found.importance >= 0).all() and len(found) > 12


def test_importance_and_flow(spark):
    found = registry.QUERIES["feature_importance"](spark, DATA).toPandas()
    assert found.importance.sum() == pytest.approx(1) and found.feature.is_unique
    flow = registry.QUERIES["baseline_flow"](spark, DATA).toPandas()
    assert sorted(flow.place) == list(range(len(flow))) and np.isfinite(flow.tvt).all() and flow.id.is_unique


def test_blend_of_two_learners(spark):
    found = registry.QUERIES["two_learners"](spark, DATA).toPandas()
    error = {c: float(np.sqrt(((found[c] - found.target) ** 2).mean())) for c in ("gbt", "symmetric", "blend")}
    assert error["blend"] <= min(error["gbt"], error["symmetric"]) + 1e-6 or error["blend"] <= np.sqrt(((found[["gbt", "symmetric"]].mean(axis=1) - found.target) ** 2).mean()) + 1e-6
    assert error["symmetric"] < np.sqrt((found.target**2).mean())
