"""Feature table, fold models, stacking and drift as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataflow.functions.scalar import rounded
from strataflow.operators import features, folds, models
from strataflow.operators.staging import output_root, staged
from strataflow.plans import residual
from strataflow.plans.wellview import BY, WELL, WELLS_SQL, WHOLE, curve, r6, wells
from strataflow.sources.template import filled

c = F.col
QUERIES: dict = {}
ORACLES: dict = {}
FOLDS, ROUNDS = 3, 12  # of the registered queries; residual.predicted has five folds, three seeds and 200 rounds by default


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = f"WITH {WELLS_SQL} {sql}"
        return fn

    return add


@query(None)
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hidden row with its features."""
    return features.window_features(wells(spark, sf_dir), WELL)[0]


@query(f"""SELECT well_id, row_id, {r6('(sum(tvt) OVER () - sum(tvt) OVER (PARTITION BY fold)) / (count(*) OVER () - count(*) OVER (PARTITION BY fold))')} AS mean_prediction FROM (SELECT *, CAST(well_id AS BIGINT) % 3 AS fold FROM w)""")
def mean_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wells(spark, sf_dir).withColumn("fold", c("well_id").cast("long") % 3)
    return models.mean_by_fold(rows, "fold", "tvt").select("well_id", "row_id", rounded(c("mean_prediction")).alias("mean_prediction"))


def _training(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    rows, names = features.window_features(wells(spark, sf_dir), WELL)
    dealt = folds.length_chunks(folds.sizes(wells(spark, sf_dir), "well_id"), "well_id", FOLDS, seed=42).select("well_id", "fold")
    return rows.join(dealt, "well_id"), names


@query(None)
def gbt_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold residuals of boosted trees with early stopping, two seeds' mean, by folds of whole wells."""
    rows, names = _training(spark, sf_dir)
    scored, _ = models.trained(staged(rows.select("well_id", "row_id", "fold", "target", *names), "training"), names, "target", "fold", "well_id", FOLDS, (42, 7), ROUNDS, 3, kinds=("gbt",))
    return scored.select("well_id", "row_id", "fold", "target", "oof")


@query(None)
def two_learners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold residuals of two different learners, node-wise and symmetric trees, and their blend by non-negative ridge."""
    rows, names = _training(spark, sf_dir)
    rows = staged(rows.select("well_id", "row_id", "fold", "target", *names), "training")
    oof = {kind: models.trained(rows, names, "target", "fold", "well_id", FOLDS, (42,), ROUNDS, 3, kinds=(kind,))[0].select("well_id", "row_id", "fold", "target", c("oof").alias(kind)) for kind in ("gbt", "symmetric")}
    both = staged(oof["gbt"].join(oof["symmetric"].drop("fold", "target"), ["well_id", "row_id"]), "oof")
    weights = models.blend_weights(both, ["gbt", "symmetric"], "target")
    return both.withColumn("blend", sum((float(w) * c(k) for w, k in zip(weights, ("gbt", "symmetric"), strict=True)), F.lit(0.0)))


@query(None)
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _training(spark, sf_dir)
    fitted = models.regressor("forest", names, "target", iterations=10, depth=4).fit(rows.fillna(-999.0, subset=names))
    return spark.createDataFrame(models.importances(fitted, names), "feature string, importance double")


_RES = f"""r AS (SELECT * FROM (SELECT *, tvt - last_value(tvt_input IGNORE NULLS) OVER ({WHOLE}) AS t, coalesce(lag(tvt) OVER ({BY}), tvt) - last_value(tvt_input IGNORE NULLS) OVER ({WHOLE}) AS a,
 avg(tvt) OVER ({BY} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - last_value(tvt_input IGNORE NULLS) OVER ({WHOLE}) AS b FROM w) WHERE tvt_input IS NULL)"""


@query(f", {_RES} SELECT {r6('sum(a * a) / count(*)')} AS aa, {r6('sum(a * b) / count(*)')} AS ab, {r6('sum(b * b) / count(*)')} AS bb, {r6('sum(a * t) / count(*)')} AS at, {r6('sum(b * t) / count(*)')} AS bt, {r6('sum(t * t) / count(*)')} AS tt, count(*) AS n FROM r")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All products that weighting two predictions needs, in one scan."""
    rows = _two(spark, sf_dir)
    p = {"aa": ("a", "a"), "ab": ("a", "b"), "bb": ("b", "b"), "at": ("a", "t"), "bt": ("b", "t"), "tt": ("t", "t")}
    return rows.agg(*(rounded(F.sum(c(x) * c(y)) / F.count("*")).alias(k) for k, (x, y) in p.items()), F.count("*").alias("n"))


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = F.last("tvt_input", ignorenulls=True).over(WELL.whole)
    before = F.coalesce(F.lag("tvt").over(WELL.window), c("tvt"))
    rows = wells(spark, sf_dir).withColumns({"t": c("tvt") - anchor, "a": before - anchor, "b": F.avg("tvt").over(WELL.centered(5)) - anchor})
    return rows.filter("tvt_input is null")


_GRAM = f"""{_RES}, g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * t) AS p, sum(b * t) AS q, sum(t * t) AS tt, count(*) AS n FROM r),
d AS (SELECT *, (aa + 1) * (bb + 1) - ab * ab AS det, aa + bb - 2 * ab AS s2 FROM g),
u AS (SELECT *, ((bb + 1) * p - ab * q) / det AS ra, ((aa + 1) * q - ab * p) / det AS rb, greatest(0, least(1, (p - q + bb - ab) / s2)) AS sa FROM d),
m AS (SELECT 'ridge' AS method, CASE WHEN ra < 0 THEN 0 WHEN rb < 0 THEN greatest(p / (aa + 1), 0) ELSE ra END AS x, CASE WHEN rb < 0 THEN 0 WHEN ra < 0 THEN greatest(q / (bb + 1), 0) ELSE rb END AS y, u.* FROM u
 UNION ALL SELECT 'simplex', sa, 1 - sa, u.* FROM u UNION ALL SELECT 'mean', 0.5, 0.5, u.* FROM u)"""


@query(f", {_GRAM} SELECT method, round(x, 4) + 0.0 AS weight_a, round(y, 4) + 0.0 AS weight_b, round(sqrt(greatest(tt - 2 * (x * p + y * q) + x * x * aa + 2 * x * y * ab + y * y * bb, 0) / n), 4) + 0.0 AS rmse FROM m")
def ensemble_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of two predictions by non-negative ridge and on the simplex, with their errors and that of the plain mean, to four digits; its one aggregate runs when the query is built."""
    g, b, tt, n = models.gram(_two(spark, sf_dir), ["a", "b"], "t")
    rows = []
    for name, w in (("ridge", models.positive_ridge(g, b)), ("simplex", models.simplex_weights(g, b)), ("mean", g.diagonal() * 0 + 0.5)):
        rows.append((name, *(round(float(x), 4) + 0.0 for x in (w[0], w[1], models.error(g, b, tt, n, w)))))
    return spark.createDataFrame(rows, "method string, weight_a double, weight_b double, rmse double")


def _drift(spark: SparkSession, sf_dir: str) -> tuple[list[tuple[str, float]], float, DataFrame]:
    rows, names = features.window_features(wells(spark, sf_dir), WELL)
    labelled = rows.withColumn("is_test", (c("well_id").cast("long") % 10 == 0).cast("double")).withColumn("key", F.concat_ws("_", "well_id", "row_id"))
    dealt = folds.stratified_rows(labelled.select("key", "is_test"), "key", "is_test", FOLDS)
    return models.drift(staged(labelled.join(dealt, "key").select("key", "is_test", "fold", *names), "drift"), names, "is_test", "fold", FOLDS)


@query(None)
def drift_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a classifier tells the test wells from the others, by folds of rows stratified by label; the models are fitted when the query is built."""
    return spark.createDataFrame([(_drift(spark, sf_dir)[1],)], "overall_auc double")


@query(None)
def drift_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which features tell the test wells from the others: mean gain over the folds' models, written as CSV and the AUC as JSON, and read back."""
    gains, auc, _ = _drift(spark, sf_dir)
    folder = f"{output_root(spark)}/drift-{uuid.uuid4().hex}"
    spark.createDataFrame(gains, "feature string, importance double").orderBy(F.desc("importance"), "feature").coalesce(1).write.option("header", True).csv(f"{folder}/importance")
    spark.createDataFrame([(auc,)], "overall_auc double").coalesce(1).write.json(f"{folder}/summary")
    auc_row = spark.read.schema("overall_auc double").json(f"{folder}/summary")
    return spark.read.schema("feature string, importance double").option("header", True).csv(f"{folder}/importance").crossJoin(F.broadcast(auc_row))


@query(None)
def full_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window features, kernels' signals, calibration, probes and surfaces of every hidden row."""
    return residual.full_features(wells(spark, sf_dir), curve(spark, sf_dir), WELL)[0]


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = wells(spark, sf_dir)
    is_test = c("well_id").cast("long") % 10 == 0
    return rows.filter(~is_test), rows.filter(is_test)


def _template(test: DataFrame) -> DataFrame:
    """place, id of the test wells' hidden rows. Places are a well's offset, from a table of wells, and the place within the well."""
    hidden = test.filter("tvt_input is null")
    before = Window.orderBy("well_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = hidden.groupBy("well_id").agg(F.count("*").alias("k")).select("well_id", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    return hidden.join(starts, "well_id").select(F.concat_ws("_", "well_id", "row_id").alias("id"), (c("start") + F.row_number().over(WELL.window) - 1).cast("long").alias("place"))


@query(None)
def residual_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From training and test wells to the template's rows: features, fold models and a refit, weights, damping, add-back."""
    train, test = _split(spark, sf_dir)
    _, fresh = residual.predicted(train, curve(spark, sf_dir), WELL, test, k=FOLDS, seeds=(42,), iterations=ROUNDS, depth=3, kinds=("gbt",))
    fallback = train.filter("tvt_input is not null").agg(F.avg("tvt").alias("fallback"))
    return filled(_template(test), fresh, fallback, "id", "tvt").select("place", "id", "tvt")


@query(None)
def baseline_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest on the training wells, saved below the shared folder, loaded again and applied to the template's rows."""
    train, test = _split(spark, sf_dir)
    rows, names = features.window_features(train, WELL)
    path = f"{output_root(spark)}/baseline-{uuid.uuid4().hex}"
    models.save_model(models.regressor("forest", names, "target", iterations=10, depth=4).fit(rows.fillna(-999.0, subset=names)), path)
    scored = models.load_model(path).transform(features.window_features(test, WELL)[0].fillna(-999.0, subset=names))
    made = scored.select(F.concat_ws("_", "well_id", "row_id").alias("id"), (c("last_known") + c("prediction")).alias("tvt"))
    fallback = train.filter("tvt_input is not null").agg(F.avg("tvt").alias("fallback"))
    return filled(_template(test), made, fallback, "id", "tvt").select("place", "id", "tvt")
