"""Quality scores from random Fourier features of document statistics.

Statistics of each whole text (text_stats.STATS) are standardised and mapped to cos(W x + b), whose inner products
approximate a Gaussian kernel. Tasks sum the normal equations over their rows, a ridge model is solved from the sums, and
isotonic regression (pooled adjacent violators over binned out-of-fold scores) turns its output into a probability.

Labels are learned from rows whose crc32(doc_id as text) mod 3 is not 1, in two folds (remainders 0 and 2): the final
model uses both, the calibration uses for each fold the model of the other. At most `max_rows` labelled rows are used,
chosen by a hash of the id, so the fit costs the same at any size; scores are given to every row.

Defined cases: null and empty texts have zero statistics and get the score of such texts; null ids are scored and count
as not held out; unlabelled rows and null labels are not learned from; a repeated labelled id takes its largest label;
equal raw scores have equal probabilities; a task holds about 40 times the longest text, of which all is counted;
without any usable label every score is 0.5. An empty table gives an empty result. Only the id and text column of the
documents and the id and label column of the labels are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm import text_stats
from strataflow.llm.common import lean, staged, table
from strataflow.llm.text_stats import STATS, matrix, stats_batches

FEATURES = 256
GAMMA = 0.02
RIDGE = 1e-3
MAX_ROWS = 200_000
PARTS = 16
BINS = 4000
HELD_OUT = 1


def remainder(id_col: str | Column) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col), F.lit(3)).cast("int")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of random features, statistics and a constant
    knots: tuple[np.ndarray, np.ndarray]  # raw score and probability, both rising

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expanded(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0)


def projection(n: int, features: int = FEATURES, gamma: float = GAMMA, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0, np.sqrt(2 * gamma), (n, features)), rng.uniform(0, 2 * np.pi, features)


def expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features, the standardised statistics (within 6 deviations) and a constant."""
    z = np.clip((x - mean) / scale, -6, 6)
    w, b = projection(z.shape[1])
    return np.hstack([np.sqrt(2 / len(b)) * np.cos(z @ w + b), z * 0.1, np.ones((len(z), 1))])


def pooled(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooled adjacent violators; inputs sorted by score. Block centres and their means."""
    rows = [list(r) for r in zip(weight.tolist(), label.tolist(), (score * weight).tolist(), weight.tolist(), strict=True)]
    # pooled twice: half a success and half a failure in each block of the first time keep the ends off 0 and 1
    for prior in (0.5, 0.0):
        blocks: list[list[float]] = []  # weight and label, both with what was added, weighted score, weight
        for row in rows:
            blocks.append(row)
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        rows = [[w + 2 * prior, y + prior, x, n] for w, y, x, n in blocks]
    return np.array([x / n for _, _, x, n in rows]), np.array([y / w for w, y, _, _ in rows])


def _sums(mean: np.ndarray, scale: np.ndarray):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            fold, y = batch.column("fold").to_numpy(), batch.column("label").to_numpy().astype(float)
            for lo in range(0, len(y), 2048):
                z = expanded(matrix(batch.slice(lo, 2048), "stats"), mean, scale)
                for f in np.unique(fold[lo : lo + 2048]).tolist():
                    on = fold[lo : lo + 2048] == f
                    t = total.setdefault(f, [0, 0, 0])
                    t[0] = t[0] + z[on].T @ z[on]
                    t[1] = t[1] + z[on].T @ y[lo : lo + 2048][on]
                    t[2] += int(on.sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t[0].tobytes() for t in total.values()], pa.binary()), pa.array([t[1].tobytes() for t in total.values()], pa.binary()), pa.array([t[2] for t in total.values()], pa.int64())], ["fold", "gram", "moment", "n"])

    return add


def solved(gram: np.ndarray, moment: np.ndarray, n: int, ridge: float = RIDGE) -> np.ndarray:
    penalty = ridge * n * np.eye(len(gram))
    penalty[-1, -1] = 1e-9 * n
    return np.linalg.solve(gram + penalty, moment)


def fit(stats: DataFrame, labels: DataFrame, label_col: str, max_rows: int = MAX_ROWS) -> Model | None:
    """stats: doc_id, stats; labels: doc_id and label_col (0 or 1)."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    rows = stats.withColumn("fold", remainder("doc_id")).filter(F.col("fold") != HELD_OUT).join(known, "doc_id")
    rows = staged(rows.select("doc_id", "stats", "fold", "label"), "quality-rows")
    n = rows.count()
    if not n:
        return None
    if n > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
    rows = rows.repartition(PARTS, "doc_id")  # so PARTS sums reach the driver, however many rows there are
    width = len(STATS)
    moments = rows.select(*(F.expr(f"avg(stats[{i}])").alias(f"m{i}") for i in range(width)), *(F.expr(f"stddev_pop(stats[{i}])").alias(f"s{i}") for i in range(width))).first()
    mean = np.array([moments[f"m{i}"] for i in range(width)])
    scale = np.array([moments[f"s{i}"] for i in range(width)])
    scale = np.where(scale > 1e-9, scale, 1.0)
    sums: dict[int, list] = {}
    for r in rows.mapInArrow(_sums(mean, scale), "fold int, gram binary, moment binary, n long").toLocalIterator():
        size = int(np.sqrt(len(r["gram"]) / 8))
        t = sums.setdefault(r["fold"], [0, 0, 0])
        t[0] = t[0] + np.frombuffer(r["gram"]).reshape(size, size)
        t[1] = t[1] + np.frombuffer(r["moment"])
        t[2] += r["n"]
    whole = solved(*(sum(t[k] for t in sums.values()) for k in range(3)))
    other = {f: solved(*(sum(t[k] for g, t in sums.items() if g != f) for k in range(3))) if len(sums) > 1 else whole for f in sums}

    def out_of_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = expanded(matrix(batch, "stats"), mean, scale)
            fold = batch.column("fold").to_numpy()
            raw = np.zeros(len(z))
            for f, w in other.items():
                raw[fold == f] = z[fold == f] @ w
            cell = np.clip(np.floor((raw + 1) / 3 * BINS), 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("label"), pa.array(raw)], ["cell", "label", "raw"])

    cells = rows.mapInArrow(out_of_fold, "cell long, label int, raw double").groupBy("cell").agg(F.count("*").alias("n"), F.sum("label").alias("y"), F.avg("raw").alias("raw")).toPandas().sort_values("raw")
    knots = pooled(cells["raw"].to_numpy(), cells["y"].to_numpy(float), cells["n"].to_numpy(float))
    return Model(mean, scale, whole, knots)


def quality_scores(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    stats = staged(rows.mapInArrow(lean(stats_batches), "doc_id long, stats array<float>"), "quality-stats")
    model = fit(stats, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias(label_col)), label_col, max_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.full(batch.num_rows, 0.5)
            for lo in range(0, batch.num_rows if model else 0, 2048):
                values[lo : lo + 2048] = model.score(matrix(batch.slice(lo, 2048), "stats"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "score"])

    scored = stats.mapInArrow(lean(score), "doc_id long, score double")
    held = F.coalesce(remainder("doc_id") == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
