"""Boosted symmetric trees: every level of a tree has one split, shared by all its nodes, found from summed histograms.

Features are binned once by their quantiles. For each level, tasks sum the residuals of their rows by leaf, feature and
bin; these histograms are summed before they reach the driver, which holds leaves x features x BINS numbers and never a
row. A split's worth is the sum over leaves of G^2 / (n + l2) on both sides. Rows set aside are not learned from; boosting
stops when their error has not fallen for `patience` trees. Trees apply as plain column expressions.

Unlike Spark's own trees, which split every node by itself, a symmetric tree of depth d has d conditions: coarser, harder
to overfit, and different enough to be worth blending with them. Absent values are whatever number fills them (-999 in
this library), as with the other learners.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.operators.staging import staged

BINS = 32


@dataclass
class SymmetricTrees:
    """base + the trees' values; a tree is its (feature, threshold) by level, and a value for each combination of x > threshold."""

    features: list[str]
    base: float
    trees: list[tuple[list[tuple[int, float]], list[float]]] = field(default_factory=list)

    @property
    def rounds(self) -> int:
        return len(self.trees)

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with prediction."""
        out = F.lit(self.base)
        for splits, values in self.trees:
            leaf = sum((F.when(F.col(self.features[f]) > edge, 1 << d).otherwise(0) for d, (f, edge) in enumerate(splits)), F.lit(0))
            out = out + F.get(F.array(*map(F.lit, values)), leaf)
        return rows.withColumn("prediction", out)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)


def _leaves(bins: np.ndarray, splits: Sequence[tuple[int, int]]) -> np.ndarray:
    leaf = np.zeros(len(bins), np.int64)
    for d, (f, b) in enumerate(splits):
        leaf |= (bins[:, f] > b).astype(np.int64) << d
    return leaf


def _binned(rows: DataFrame, features: Sequence[str], target: str, aside: str | None, edges: list[np.ndarray]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [np.searchsorted(e, batch.column(i).to_numpy(zero_copy_only=False), "left").astype(np.uint8) for i, e in enumerate(edges)]
            lines = np.ascontiguousarray(np.stack(columns, 1)) if len(batch) else np.zeros((0, len(edges)), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in lines], pa.binary()), batch.column(len(edges)), batch.column(len(edges) + 1)], names=["bins", "t", "aside"])

    plain = rows.select(*(F.col(f).cast("double") for f in features), F.col(target).cast("double").alias("_t"), (F.col(aside) if aside else F.lit(False)).alias("_aside")).filter("_t is not null")
    return staged(plain.mapInArrow(work, "bins binary, t double, aside boolean"), "binned")


def _histograms(binned: DataFrame, base: float, trees: list, splits: list[tuple[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(sums of residuals, counts) by leaf, feature and bin of the rows learned from, and the squared error of those set aside."""
    shape = (1 << len(splits), width, BINS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, n, wrong = np.zeros(shape).reshape(shape[0], -1), np.zeros(shape, np.int64).reshape(shape[0], -1), 0.0
        for batch in batches:
            bins, t, aside = _matrix(batch, width), batch.column("t").to_numpy(), batch.column("aside").to_numpy(zero_copy_only=False).astype(bool)
            left = t - base
            for s, values in trees:
                left -= np.asarray(values)[_leaves(bins, s)]
            wrong += float((left[aside] ** 2).sum())
            bins, left = bins[~aside], left[~aside]
            leaf = _leaves(bins, splits)
            for f in range(width):
                at = leaf * BINS + bins[:, f]
                g[:, f * BINS : (f + 1) * BINS] += np.bincount(at, left, shape[0] * BINS).reshape(shape[0], BINS)
                n[:, f * BINS : (f + 1) * BINS] += np.bincount(at, minlength=shape[0] * BINS).reshape(shape[0], BINS)
        on = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([*on.tolist(), -1], pa.int64()), pa.array([*g.ravel()[on].tolist(), wrong]), pa.array([*n.ravel()[on].tolist(), 0], pa.int64())], names=["i", "g", "n"])

    summed = binned.mapInArrow(work, "i long, g double, n long").groupBy("i").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).collect()
    g, n, wrong = np.zeros(shape), np.zeros(shape, np.int64), 0.0
    for r in summed:
        if r["i"] < 0:
            wrong = r["g"]
        else:
            g.flat[r["i"]], n.flat[r["i"]] = r["g"], r["n"]
    return g, n, wrong


def best_split(g: np.ndarray, n: np.ndarray, l2: float, usable: Sequence[int]) -> tuple[int, int]:
    """(feature, bin) with the most worth; rows in higher bins go to the upper side. The first of equals."""
    gl, nl = np.cumsum(g, 2)[..., :-1], np.cumsum(n, 2)[..., :-1]
    gr, nr = g.sum(2)[..., None] - gl, n.sum(2)[..., None] - nl
    worth = (gl**2 / (nl + l2) + gr**2 / (nr + l2)).sum(0)[list(usable)]
    at = int(np.argmax(worth))
    return usable[at // (BINS - 1)], at % (BINS - 1)


def fit(rows: DataFrame, features: Sequence[str], target: str, iterations: int = 100, depth: int = 4, rate: float = 0.1, l2: float = 1.0, seed: int = 42, feature_share: float = 0.8, aside: str | None = None, patience: int = 10) -> SymmetricTrees | None:
    """Trees for a target; each looks at a share of the features, drawn by the seed. None without rows to learn from."""
    features, rng = list(features), np.random.default_rng(seed)
    quantiles = rows.select(*(F.col(f).cast("double") for f in features)).approxQuantile(features, [i / BINS for i in range(1, BINS)], 0.005)
    edges = [np.unique(q) for q in quantiles]
    binned = _binned(rows, features, target, aside, edges)
    n, mean = binned.filter("not aside").agg(F.count("*"), F.avg("t")).first()
    if not n:
        return None
    model, trees, errors = SymmetricTrees(features, mean), [], []
    for _ in range(iterations):
        usable = sorted(rng.choice(len(features), max(1, round(feature_share * len(features))), replace=False).tolist())
        splits: list[tuple[int, int]] = []
        for level in range(depth):
            g, counts, wrong = _histograms(binned, mean, trees, splits, len(features))
            if not level:
                errors.append(wrong)
            splits.append(best_split(g, counts, l2, usable))
        f, b = splits[-1]
        low = (g[:, f, : b + 1].sum(1), counts[:, f, : b + 1].sum(1))
        high = (g[:, f, b + 1 :].sum(1), counts[:, f, b + 1 :].sum(1))
        values = [float(rate * s / (k + l2)) for side in (low, high) for s, k in zip(*side, strict=True)]
        trees.append((splits, values))
        # errors[k] is that of k trees
        if aside and len(errors) - 1 - int(np.argmin(errors)) >= patience:
            break
    if aside:
        errors.append(_histograms(binned, mean, trees, [], len(features))[2])
        trees = trees[: int(np.argmin(errors))]
    infinite = lambda f, b: float(edges[f][b]) if b < len(edges[f]) else float("inf")
    model.trees = [([(f, infinite(f, b)) for f, b in s], values) for s, values in trees]
    return model
