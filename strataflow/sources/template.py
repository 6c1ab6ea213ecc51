"""Templates: an ordered list of ids that a result must follow, its filling, checking and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.sources import ordered


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """place (from 0), id of a CSV file with the columns id and tvt, in file order; a large file is read by many tasks."""
    return ordered.numbered(spark, path, "id string, tvt double").select("place", "id")


def filled(template: DataFrame, predictions: DataFrame, fallback: DataFrame, key: str, value: str) -> DataFrame:
    """template with the predictions' value; ids without one take the single value of fallback."""
    joined = template.join(predictions.select(key, value), key, "left").crossJoin(F.broadcast(fallback.select(F.first(fallback.columns[0]).alias("_f"))))
    return joined.withColumn(value, F.coalesce(value, "_f")).drop("_f")


def faults(template: DataFrame, result: DataFrame, key: str, value: str) -> dict[str, int]:
    """Counts of ids that are absent, extra, repeated or out of place, and of values that are not finite; all 0 for a valid result."""
    a, b = template.select(key, F.col("place").alias("_a")), result.select(key, F.col("place").alias("_b"), F.col(value).alias("_v"))
    repeated = b.groupBy(key).count().filter("count > 1").count()
    both = a.join(b, key, "full")
    bad = ~F.coalesce(F.abs(F.col("_v")) < float("inf"), F.lit(False))
    counts = both.agg(F.count_if(F.col("_b").isNull()).alias("absent"), F.count_if(F.col("_a").isNull()).alias("extra"), F.count_if(F.col("_a") != F.col("_b")).alias("misplaced"), F.count_if(F.col("_b").isNotNull() & bad).alias("not_finite")).first()
    return counts.asDict() | {"repeated": repeated}


def write_result(result: DataFrame, folder: str, key: str = "id", value: str = "tvt") -> str:
    """result (with place) as parts of CSV in a folder, and one file of them, whose path is returned."""
    ordered.write_ordered(result.select("place", key, value), folder)
    return ordered.joined(result.sparkSession, folder)
