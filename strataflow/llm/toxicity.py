"""Toxicity by a classifier chain.

The vocabulary of toxic texts is counted over the labelled training rows: words and four-letter stems whose document
frequency in toxic texts is many times that in others. For each fold of training rows it is counted without them, so what
they are described by has not seen their labels; equal texts share a fold. From the vocabulary each text gets a few statistics (whether, how often and how
densely such words occur). A chain of linear models then predicts the categories in order; each later model also takes
the probabilities of the earlier categories, which for training rows are out-of-fold predictions. The categories are
`repeated` and `dense` (toxic texts with many, or closely set, toxic words, above the median of toxic rows) and last
`toxic`, the given label, whose probability is the score.

Labels are learned from rows whose crc32(doc_id as text) mod 3 is not 1, at most `max_rows` of them, chosen by a hash of
the id; every row is scored. Defined cases: null and empty texts hold no words; null ids are scored; unlabelled rows and
null labels are not learned from; a repeated labelled id takes its largest label; equal texts with both labels count as
toxic; long texts are counted whole; without any toxic training row every score is 0. An empty table gives an empty result. Only the id and text column, and the labels' id and label column, are
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import staged, table
from strataflow.llm.quality import HELD_OUT, MAX_ROWS, PARTS, remainder, solved
from strataflow.llm.text_stats import matrix

FOLDS = 4
RATIO, SUPPORT, TERMS = 20.0, 0.004, 4000
STEM = 4
WORD = re.compile(r"[^\W\d_]+")
CHAIN = ("repeated", "dense", "toxic")
FEATURES = 9


def terms_of(text: str) -> set[str]:
    """A text's words, and its longer words' stems (marked by a final dash)."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:STEM] + "-" for w in words if len(w) > STEM + 1}


def vocabularies(rows: DataFrame, ratio: float = RATIO, support: float = SUPPORT, terms: int = TERMS) -> list[dict[str, float]]:
    """Log ratio by term, for the `terms` strongest: of all rows, then of all but each fold; rows: text, label, fold. Equal texts, which share a fold, count once."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "fold")), strict=True):
                found = list(terms_of(text))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([label] * len(found), pa.int32()), pa.array([fold] * len(found), pa.int32())], ["term", "label", "fold"])

    once = rows.groupBy(F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text"), F.max("label").alias("label"), F.first("fold").alias("fold"))
    once = staged(once.select("text", "label", "fold"), "toxic-texts")
    sizes = {r["fold"]: (r["n"], r["k"]) for r in once.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("k")).collect()}
    inside = lambda f, x: F.sum(F.when(F.col("fold") == f, x).otherwise(0))
    by_fold = [inside(f, x).alias(f"{name}{f}") for f in range(FOLDS) for name, x in (("a", F.col("label")), ("b", 1 - F.col("label")))]
    counted = once.mapInArrow(explode, "term string, label int, fold int").groupBy("term").agg(*by_fold)
    least = " + ".join(f"a{f}" for f in range(FOLDS))
    counted = staged(counted.filter(f"{least} >= 3"), "toxic-terms")
    out = []
    for left_out in (None, *range(FOLDS)):
        folds = [f for f in range(FOLDS) if f != left_out]
        n, k = (sum(sizes.get(f, (0, 0))[i] or 0 for f in folds) for i in range(2))
        a, b = (F.expr(" + ".join(f"{x}{f}" for f in folds)) for x in "ab")
        strength = F.log((a + 0.5) / (k + 1)) - F.log((b + 0.5) / (n - k + 1))
        kept = counted.filter(a >= max(3, support * k)).withColumn("w", strength).filter(F.col("w") >= float(np.log(ratio)))
        out.append({r["term"]: r["w"] for r in kept.orderBy(F.desc("w"), "term").limit(terms).select("term", "w").collect()} if k else {})
    return out


def features(text: str, weights: dict[str, float]) -> list[float]:
    words = WORD.findall(text.lower())
    hits = [w for w in words if w in weights]
    stems = [w for w in words if len(w) > STEM + 1 and w[:STEM] + "-" in weights]
    n = max(len(words), 1)
    both = len(hits) + len(stems)
    return [bool(hits), bool(stems), len(set(hits)) > 1 or len(set(stems)) > 1, np.log1p(len(hits)), np.log1p(len(stems)), np.log1p(1000 * both / n), min(30.0, sum(weights[w] for w in set(hits))) / 10, np.log1p(len(words)), 1.0]


def _labels(x: np.ndarray, toxic: np.ndarray, cuts: tuple[float, float]) -> np.ndarray:
    """One column a category of CHAIN."""
    often = x[:, 3] + x[:, 4]
    return np.column_stack([toxic * (often > cuts[0]), toxic * (x[:, 5] > cuts[1]), toxic]).astype(float)


def chained(x: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Probabilities of the categories, one after the other."""
    out = np.zeros((len(x), 0))
    for w in weights:
        p = np.clip(np.hstack([out, x]) @ w, 0, 1)
        out = np.hstack([out, p[:, None]])
    return out


def fit_chain(rows: DataFrame) -> list[np.ndarray]:
    """rows: fold, label, x. One pass a category: tasks sum normal equations by fold, with the earlier categories' out-of-fold probabilities as inputs."""
    toxic = rows.filter("label = 1").select((F.col("x")[3] + F.col("x")[4]).alias("often"), F.col("x")[5].alias("dense"))
    cuts = tuple(v or 0.0 for v in toxic.agg(F.expr("percentile(often, 0.5)"), F.expr("percentile(dense, 0.5)")).first())
    whole: list[np.ndarray] = []
    apart: list[dict[int, np.ndarray]] = []  # by category: the model without each fold
    for k in range(len(CHAIN)):

        def add(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for batch in batches:
                x, fold = matrix(batch, "x"), batch.column("fold").to_numpy()
                y = _labels(x, batch.column("label").to_numpy(), cuts)[:, k]
                for f in np.unique(fold).tolist():
                    on = fold == f
                    z = np.hstack([chained(x[on], [a[f] for a in apart]), x[on]])
                    t = total.setdefault(f, [0, 0, 0])
                    t[0], t[1], t[2] = t[0] + z.T @ z, t[1] + z.T @ y[on], t[2] + int(on.sum())
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t[0].tobytes() for t in total.values()], pa.binary()), pa.array([t[1].tobytes() for t in total.values()], pa.binary()), pa.array([t[2] for t in total.values()], pa.int64())], ["fold", "gram", "moment", "n"])

        size = k + FEATURES
        sums: dict[int, list] = {}
        for r in rows.mapInArrow(add, "fold int, gram binary, moment binary, n long").collect():  # PARTS * FOLDS small rows
            t = sums.setdefault(r["fold"], [0, 0, 0])
            t[0], t[1], t[2] = t[0] + np.frombuffer(r["gram"]).reshape(size, size), t[1] + np.frombuffer(r["moment"]), t[2] + r["n"]
        whole.append(solved(*(sum(t[i] for t in sums.values()) for i in range(3)), ridge=1e-5))
        apart.append({f: solved(*(sum(t[i] for g, t in sums.items() if g != f or len(sums) == 1) for i in range(3)), ridge=1e-5) for f in sums})
    return whole


def toxicity_scores(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, repeated, dense (probabilities), score (that of toxic), predicted for each row."""
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    known = known.filter(remainder("doc_id") != HELD_OUT).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = staged(known, "toxic-labels")
    n = known.count()
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")
    train = staged(rows.join(known, "doc_id").withColumn("fold", fold), "toxic-rows")
    weights = vocabularies(train)
    sent = spark.sparkContext.broadcast(weights)  # FOLDS + 1 times TERMS entries at most

    def described(batch: pa.RecordBatch, folds: list[int]) -> np.ndarray:
        """Features by the whole vocabulary (fold -1), or by the one that was counted without the row's fold."""
        texts = batch.column("text").to_pylist()
        return np.array([features(t, sent.value[1 + f]) for t, f in zip(texts, folds, strict=True)], np.float64).reshape(-1, FEATURES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = described(batch, batch.column("fold").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("fold"), lists], ["label", "fold", "x"])

    model = []
    if weights[0]:
        learned = train.select("text", "label", "fold").mapInArrow(measure, "label int, fold int, x array<double>")
        model = fit_chain(staged(learned.repartition(PARTS), "toxic-train"))  # so PARTS sums reach the driver, however many rows there are

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chained(described(batch, [-1] * batch.num_rows), model) if model else np.zeros((batch.num_rows, len(CHAIN)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, i]) for i in range(len(CHAIN)))], ["doc_id", *CHAIN])

    scored = rows.mapInArrow(score, "doc_id long, repeated double, dense double, toxic double")
    held = F.coalesce(remainder("doc_id") == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "repeated", "dense", F.col("toxic").alias("score"), (F.col("toxic") >= 0.5).cast("int").alias("predicted"))


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
