"""Model operators: baselines, boosted trees by folds, stacking from one Gram matrix, drift."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from statistics import median

import numpy as np
from pyspark.errors import IllegalArgumentException, PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.operators import symmetric


def mean_by_fold(rows: DataFrame, fold: str, target: str) -> DataFrame:
    """Adds mean_prediction: the target's mean over the other folds, from one small aggregate."""
    sums = rows.groupBy(fold).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    total = sums.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    means = sums.crossJoin(F.broadcast(total)).select(fold, F.try_divide(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n")).alias("mean_prediction"))
    return rows.join(F.broadcast(means), fold)


def regressor(kind: str, features: Sequence[str], target: str, seed: int = 42, iterations: int = 20, depth: int = 4, validation: str | None = None) -> Pipeline:
    """gbt, gbt_deep (fewer, deeper trees with smaller steps), or forest as their fallback; absent features count as -999. trained() also knows symmetric (operators/symmetric.py).

    validation: a boolean column; its rows are not learned from, boosting stops once they get no better.
    """
    if kind == "forest":
        model = RandomForestRegressor(labelCol=target, featuresCol="_x", numTrees=iterations, maxDepth=depth, seed=seed)
    else:
        step, share, deeper = (0.1, 0.8, 0) if kind == "gbt" else (0.05, 0.6, 1)
        model = GBTRegressor(labelCol=target, featuresCol="_x", maxIter=iterations, maxDepth=depth + deeper, stepSize=step, seed=seed, subsamplingRate=share, validationTol=0.001)
        if validation:
            model = model.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), model])


def set_aside(group: str, seed: int, share: int = 8) -> Column:
    """Whether a group is one of every `share` that early stopping looks at, by a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(share)) == 0


def _scores(fitted: Sequence[PipelineModel], rows: DataFrame, name: str) -> DataFrame:
    """rows with the mean prediction of the models; 0 without any."""
    out, made = rows, []
    for i, model in enumerate(fitted):
        out = model.transform(out).withColumnRenamed("prediction", f"_p{i}").drop("_x")
        made.append(f"_p{i}")
    mean = sum((F.col(n) for n in made[1:]), F.col(made[0])) / len(made) if made else F.lit(0.0)
    return out.withColumn(name, mean).drop(*made)


def _rounds(model: PipelineModel | symmetric.SymmetricTrees) -> int:
    return model.rounds if isinstance(model, symmetric.SymmetricTrees) else model.stages[-1].getNumTrees


def _fitted(rows: DataFrame, features: Sequence[str], target: str, group: str, kind: str, seed: int, iterations: int, depth: int, stop: bool) -> PipelineModel | symmetric.SymmetricTrees | None:
    """A model, or None where there is nothing to learn from or its trainer fails on the rows, which is logged: a residual of 0 stands in for it."""
    marked = rows.withColumn("_aside", set_aside(group, seed))
    if stop and marked.select("_aside").distinct().count() < 2:
        stop = False
    if rows.isEmpty():
        return None
    aside = "_aside" if stop else None
    try:
        if kind == "symmetric":  # a level has one split: a level more stands for as many rows a leaf
            return symmetric.fit(marked, features, target, iterations, depth + 1, seed=seed, aside=aside)
        return regressor(kind, features, target, seed, iterations, depth, aside).fit(marked)
    except (PySparkException, IllegalArgumentException) as e:
        logging.getLogger(__name__).warning("%s trees, seed %d: %s", kind, seed, e)
        return None


def trained(rows: DataFrame, features: Sequence[str], target: str, fold: str, group: str, folds: int, seeds: Sequence[int], iterations: int, depth: int, test: DataFrame | None = None, kinds: Sequence[str] = ("gbt", "gbt_deep"), refit_share: float = 0.5) -> tuple[DataFrame, DataFrame | None]:
    """(rows with oof, test with oof): for each fold the models of the other folds, by kind and seed.

    For the test rows the folds' models are averaged, and blended by refit_share with models fitted again on all rows, for
    the rounds that robust_iterations takes from the folds'. rows and test should be cached: each is read once a model.
    """
    filled = rows.fillna(-999.0, subset=list(features))
    parts, by_fold, rounds = [], [], {k: [] for k in kinds}
    for f in range(folds):
        other = filled.filter(F.col(fold) != f)
        made = []
        for kind in kinds:
            for seed in seeds:
                model = _fitted(other, features, target, group, kind, seed, iterations, depth, True)
                if model is not None:
                    made.append(model)
                    rounds[kind].append(_rounds(model))
        by_fold += made
        parts.append(_scores(made, filled.filter(F.col(fold) == f), "oof"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if test is None:
        return out, None
    again = []
    for kind in kinds:
        for seed in seeds if rounds[kind] else ():
            # the rule's floor of 50 rounds would exceed `iterations` where these are few
            refit = _fitted(filled, features, target, group, kind, seed, min(iterations, robust_iterations(rounds[kind], least=1)), depth, False)
            again += [refit] if refit is not None else []
    asked = test.fillna(-999.0, subset=list(features))
    both = _scores(again, _scores(by_fold, asked, "_folds"), "_again")
    return out, both.withColumn("oof", (1 - refit_share) * F.col("_folds") + refit_share * F.col("_again")).drop("_folds", "_again")


def out_of_fold(rows: DataFrame, features: Sequence[str], target: str, fold: str, folds: int, seeds: Sequence[int] = (42,), kind: str = "gbt", iterations: int = 20, depth: int = 4) -> DataFrame:
    """Adds oof: the mean over seeds of models that did not see the row's fold. rows is read once a model."""
    return trained(rows, features, target, fold, fold, folds, seeds, iterations, depth, kinds=(kind,))[0]


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, values.tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def gram(rows: DataFrame, columns: Sequence[str], target: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Products of the columns with each other and with the target, that of the target with itself, and the rows, in one aggregate."""
    k = len(columns)
    pairs = [F.sum(F.col(columns[i]) * F.col(columns[j])) for i in range(k) for j in range(i, k)]
    cross = [F.sum(F.col(c) * F.col(target)) for c in columns]
    row = rows.agg(*pairs, *cross, F.sum(F.col(target) * F.col(target)), F.count("*")).first()
    g, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[at]
            at += 1
    return g, np.array([float(row[at + i]) for i in range(k)]), float(row[at + k]), int(row[at + k + 1])


def positive_ridge(g: np.ndarray, b: np.ndarray, alpha: float = 1.0, rounds: int = 2000) -> np.ndarray:
    """Non-negative ridge weights without an intercept, by coordinate descent on the Gram matrix."""
    w = np.zeros(len(b))
    for _ in range(rounds):
        before = w.copy()
        for i in range(len(b)):
            w[i] = max(0.0, (b[i] - g[i] @ w + g[i, i] * w[i]) / (g[i, i] + alpha))
        if np.abs(w - before).max() < 1e-12:
            break
    return w


def simplex_weights(g: np.ndarray, b: np.ndarray, rounds: int = 5000) -> np.ndarray:
    """Non-negative weights of sum 1 with the least squared error, by projected gradient on the Gram matrix."""
    n = len(b)
    w, step = np.full(n, 1 / n), 1 / max(np.linalg.eigvalsh(g).max(), 1e-12)
    for _ in range(rounds):
        v = w - step * (g @ w - b)
        u = np.sort(v)[::-1]
        total = np.cumsum(u) - 1
        k = np.flatnonzero(u - total / np.arange(1, n + 1) > 0)[-1]
        moved = np.maximum(v - total[k] / (k + 1), 0)
        if np.abs(moved - w).max() < 1e-12:
            break
        w = moved
    return w


def weighted(columns: Sequence[str], weights: np.ndarray) -> Column:
    return sum((float(w) * F.col(c) for w, c in zip(weights[1:], columns[1:], strict=True)), float(weights[0]) * F.col(columns[0]))


def blend_weights(rows: DataFrame, columns: Sequence[str], target: str) -> np.ndarray:
    """Weights by positive ridge if their error is below that of the plain mean, else the mean's."""
    g, b, tt, n = gram(rows, columns, target)
    plain, ridge = np.full(len(columns), 1 / len(columns)), positive_ridge(g, b)
    return ridge if error(g, b, tt, n, ridge) < error(g, b, tt, n, plain) else plain


def error(g: np.ndarray, b: np.ndarray, tt: float, n: int, w: np.ndarray) -> float:
    """Root mean squared error of the weighted columns."""
    return float(np.sqrt(max(tt - 2 * w @ b + w @ g @ w, 0) / n))


def robust_iterations(counts: Sequence[int], scale: float = 1.10, least: int = 50) -> int:
    """Iterations for a refit on all rows, from the folds' best: the larger of the median and 0.8 of the third quartile, scaled up."""
    third = float(np.percentile(list(counts), 75))
    return max(least, int(max(median(counts), 0.8 * third) * scale))


def drift(rows: DataFrame, features: Sequence[str], label: str, fold: str, folds: int, iterations: int = 10) -> tuple[list[tuple[str, float]], float, DataFrame]:
    """Mean importance of each feature over the folds' models, largest first; the AUC of the out-of-fold probability that a row belongs to the second split; and the rows with it."""
    filled = rows.fillna(-999.0, subset=list(features))
    parts, gains = [], np.zeros(len(features))
    for f in range(folds):
        stages = [VectorAssembler(inputCols=list(features), outputCol="_x"), GBTClassifier(labelCol=label, featuresCol="_x", maxIter=iterations, maxDepth=3, seed=42)]
        fitted = Pipeline(stages=stages).fit(filled.filter(F.col(fold) != f))
        gains += fitted.stages[-1].featureImportances.toArray() / folds
        scored = fitted.transform(filled.filter(F.col(fold) == f))
        parts.append(scored.withColumn("p", vector_to_array("probability")[1]).drop("_x", "probability", "prediction", "rawPrediction"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ranked = sorted(zip(features, gains.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return ranked, BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="p").evaluate(out), out
