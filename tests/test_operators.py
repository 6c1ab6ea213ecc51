"""Lookups, neighbours, folds, post-processing, sources and streams."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import DATA
from strataflow.operators import curves, folds, models, post, spatial
from strataflow.plans.wellview import WELL, curve, wells
from strataflow.sources import template, wells as sources
from strataflow.streaming.anchors import latest_known, windowed_counts


def test_lookup_is_numpys(spark):
    rng = np.random.default_rng(1)
    knots = pd.DataFrame({"g": np.repeat(["a", "b"], 20), "t": np.concatenate([np.sort(rng.choice(1000, 20, replace=False)) for _ in range(2)]).astype(float), "v": rng.normal(size=40)})
    rows = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 300), "id": range(300), "q": rng.uniform(-50, 1050, 300)})
    rows.loc[::7, "q"] = knots["t"].sample(len(rows.loc[::7]), replace=True, random_state=1).to_numpy()
    rows.loc[::31, "q"] = np.nan
    df = spark.createDataFrame(rows).withColumn("q", F.nanvl("q", F.lit(None)))
    found = curves.lookup(df, "q", spark.createDataFrame(knots), "t", ["v"], ["g"]).select("id", curves.linear(F.col("q"), "v").alias("y"), curves.linear(F.col("q"), "v", False).alias("strict"), "below").toPandas().set_index("id")
    assert len(found) == 300
    for r in rows.itertuples():
        k = knots[knots.g == r.g]
        y = found.loc[r.id]
        if r.g == "c" or np.isnan(r.q):
            assert pd.isna(y["y"])
            continue
        assert y["y"] == pytest.approx(np.interp(r.q, k.t, k.v))
        assert y["below"] == np.searchsorted(k.t, r.q)
        assert pd.isna(y["strict"]) == (r.q < k.t.min() or r.q > k.t.max())


@pytest.mark.parametrize("block", [50_000, 60])
def test_nearest_in_blocks_is_brute_force(spark, block):
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"pid": range(200), "x": rng.normal(size=200), "y": rng.normal(size=200), "value": rng.normal(size=200)})
    p.loc[5, "value"] = np.nan
    points = spark.createDataFrame(p).withColumn("value", F.nanvl("value", F.lit(None)))
    got = spatial.nearest(points.select(F.col("pid").alias("qid"), "x", "y"), points, 4, cell=block).toPandas().set_index("qid")
    ok = p.dropna()
    for q in (0, 5, 77, 199):
        others = ok[ok.pid != q]
        d = np.hypot(others.x - p.x[q], others.y - p.y[q])
        assert [n["pid"] for n in got.loc[q, "neighbours"]] == others.pid[d.sort_values().index[:4]].tolist()


def test_plane_recovers_a_plane(spark):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"pid": range(80), "x": rng.normal(size=80), "y": rng.normal(size=80)})
    p["value"] = 3 * p.x - 2 * p.y + 5
    points = spark.createDataFrame(p)
    q = points.select(F.col("pid").alias("qid"), "x", "y")
    found = spatial.inverse_distance(spatial.nearest(q, points, 10)).join(q.select("qid", F.col("x").alias("qx"), F.col("y").alias("qy")), "qid")
    got = spatial.plane(found, {"value": (float(p.value.min()), float(p.value.max()))}).toPandas().set_index("qid")["surface_value"]
    np.testing.assert_allclose(got.sort_index(), p.value, atol=1e-4)


def test_folds(spark):
    sizes = folds.sizes(wells(spark, DATA), "well_id")
    for dealt in (folds.balanced(sizes, "well_id", 5), folds.shuffled(sizes, "well_id", 5, 1), folds.length_chunks(sizes, "well_id", 5, 1)):
        pdf = dealt.toPandas()
        assert len(pdf) == sizes.count() and set(pdf["fold"]) <= set(range(5))
    rows = folds.balanced(sizes, "well_id", 3).groupBy("fold").agg(F.sum("n").alias("n")).toPandas()["n"]
    assert rows.max() - rows.min() <= sizes.agg(F.max("n")).first()[0]
    chunked = folds.length_chunks(sizes, "well_id", 5, 7).groupBy("chunk").agg(F.count("*").alias("n"), F.countDistinct("fold").alias("k")).toPandas()
    assert (chunked["n"] == chunked["k"]).all()


def test_even_sample_is_linspace(spark):
    for n in (1, 2, 7, 20, 53):
        df = spark.createDataFrame([("w", i) for i in range(n)], "well_id string, row_id int")
        got = sorted(r["row_id"] for r in folds.evenly_spaced(df, WELL, 10).collect())
        assert got == sorted(set(np.linspace(0, n - 1, min(10, n), dtype=int).tolist()))


def test_features_do_not_see_hidden_depths(spark):
    from strataflow.operators.features import window_features

    rows = wells(spark, DATA)
    moved = rows.withColumn("tvt", F.when(F.col("tvt_input").isNull(), F.col("tvt") + 1000).otherwise(F.col("tvt")))
    a, names = window_features(rows, WELL)
    b, _ = window_features(moved, WELL)
    key = ["well_id", "row_id", *names]
    assert a.select(*key).exceptAll(b.select(*key)).isEmpty()


def test_results_do_not_depend_on_partitions(spark):
    from strataflow.operators import alignment

    columns = "pf_mean double, pf_std double"
    of = lambda found: found.toPandas().sort_values(["well_id", "row_id"]).reset_index(drop=True)
    run = lambda w: of(alignment.per_batch(w, curve(spark, DATA), columns, alignment.surface_filters))
    rows = wells(spark, DATA)
    one = run(rows)
    pd.testing.assert_frame_equal(one, run(rows.repartition(7, "row_id")))
    pd.testing.assert_frame_equal(one, of(alignment.per_well(rows, curve(spark, DATA), columns, alignment.surface_filter)))


def test_batches_hold_whole_wells(spark):
    from strataflow.operators import alignment

    # wells cut by the batches of Arrow, a well without an id, one without a curve, a curve without a well, extra columns
    rows, knots = wells(spark, DATA), curve(spark, DATA)
    ids = sorted(r.well_id for r in rows.select("well_id").distinct().collect())
    unnamed = lambda x: x.withColumn("well_id", F.when(F.col("well_id") != ids[0], F.col("well_id"))).withColumn("is_row", F.lit("x"))
    rows, knots = unnamed(rows.filter(F.col("well_id") != ids[2])), unnamed(knots.filter(F.col("well_id") != ids[1]))
    of = lambda found: found.toPandas().sort_values(["well_id", "row_id"]).reset_index(drop=True)
    want = of(alignment.per_well(rows, knots, alignment.BEAM_COLUMNS, alignment.beams))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = of(alignment.per_batch(rows, knots, alignment.BEAM_COLUMNS, alignment.beams_of_wells))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pd.testing.assert_frame_equal(got, want)
    assert got["well_id"].isna().any() and not set(ids[1:3]) & set(got["well_id"].dropna())
    assert alignment.per_batch(rows.limit(0), knots, alignment.BEAM_COLUMNS, alignment.beams_of_wells).count() == 0


def test_grid_search_and_optimum(spark):
    df = spark.createDataFrame([(float(i), 0.8 * i, float(i)) for i in range(1, 50)], "residual double, target double, since double")
    best = post.grid_search(df, "residual", "target", "since", [0.6, 0.8, 1.0], [0.0, 10.0]).orderBy("rmse", "place").first()
    assert (best["alpha"], best["tau"]) == (0.8, 0.0) and best["rmse"] == pytest.approx(0, abs=1e-6)
    assert post.median_optimum([0.8, 0.9, 1.0], [None, 10.0, 12.0]) == (0.9, None)
    assert post.median_optimum([0.8, 0.9], [20.0, 30.0]) == (pytest.approx(0.85), 25.0)


def test_out_of_fold_beats_the_mean(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "t": 3 * x, "fold": np.arange(400) % 2}))
    out = models.out_of_fold(df, ["x"], "t", "fold", 2, iterations=5, depth=3).toPandas()
    assert len(out) == 400 and ((out.oof - out.t) ** 2).mean() < 0.3 * (out.t**2).mean()
    assert models.out_of_fold(df, ["x"], "t", "fold", 2, kind="forest", iterations=3).count() == 400


def test_sources(spark, tmp_path):
    for split in ("train", "test"):
        (tmp_path / split).mkdir()
    head = [f.split()[0] for f in sources.TRAIN.split(", ")]
    (tmp_path / "train/a__horizontal_well.csv").write_text(",".join(head) + "\n" + ",".join(["1"] * 11 + ["", "nan"]) + "\n" + ",".join(["2"] * 13) + "\n")
    (tmp_path / "train/a__typewell.csv").write_text("TVT,GR,Geology\n1,5,BUDA\n2,6,other\n")
    (tmp_path / "train/a.png").write_bytes(b"12345")
    got = sources.read_wells(spark, str(tmp_path), "train").orderBy("row_id").collect()
    assert [(r.well_id, r.row_id, r.GR, r.TVT_input) for r in got] == [("a", 0, None, None), ("a", 1, 2.0, 2.0)]
    assert [r.code for r in sources.read_curves(spark, str(tmp_path), "train").orderBy("TVT").collect()] == [9, -1]
    counts = {(r.split, r.kind): (r.file_count, r.total_bytes) for r in sources.inventory(spark, str(tmp_path)).collect()}
    assert counts["train", "png"] == (1, 5) and counts["test", "png"] == (0, 0) and counts["train", "horizontal"][0] == 1
    (tmp_path / "train/a__horizontal_well.csv").write_text("Q," + ",".join(head[1:]) + "\n" + ",".join(["1"] * 13) + "\n")
    with pytest.raises(Exception, match="(?i)header|schema|column"):
        sources.read_wells(spark, str(tmp_path), "train").collect()
    with pytest.raises(ValueError):
        sources.pattern("x", "train", "jpg")
    with pytest.raises(ValueError):
        sources.rejected_columns(spark.createDataFrame([(1.0,)], "TVT double"))


def test_template_round_trip(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,tvt\nb_2,0\na_1,0\na_0,0\n")
    order = template.read_template(spark, str(tmp_path / "t.csv"))
    predictions = spark.createDataFrame([("a_0", 1.5), ("b_2", 2.5)], "id string, tvt double")
    done = template.filled(order, predictions, spark.createDataFrame([(9.0,)], "m double"), "id", "tvt")
    assert not any(template.faults(order, done, "id", "tvt").values())
    assert template.faults(order, done.filter("id <> 'a_1'"), "id", "tvt")["absent"] == 1
    lines = Path(template.write_result(done, str(tmp_path / "out"))).read_text().split()
    assert lines[0] == "id,tvt" and [(i, float(v)) for i, v in (x.split(",") for x in lines[1:])] == [("b_2", 2.5), ("a_1", 9.0), ("a_0", 1.5)]


def test_streams(spark, tmp_path):
    rows = wells(spark, DATA).select("well_id", "row_id", "tvt_input")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = latest_known(stream).writeStream.outputMode("complete").format("memory").queryName("anchors").start()
    q.processAllAvailable()
    q.stop()
    a = {r.well_id: r.anchor for r in spark.table("anchors").collect()}
    assert a == {r.well_id: r.anchor for r in latest_known(rows).collect()}
    assert windowed_counts(spark.read.parquet(f"{DATA}/events.parquet")).count() > 0
