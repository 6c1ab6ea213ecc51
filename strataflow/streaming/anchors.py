"""Running anchors: the last known value of each well over a stream of rows, and windowed counts with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_known(rows: DataFrame) -> DataFrame:
    """well_id, anchor, at: the known value with the largest row_id so far; state is one row a well (update mode)."""
    known = rows.filter(F.col("tvt_input").isNotNull())
    return known.groupBy("well_id").agg(F.max(F.struct("row_id", "tvt_input")).alias("m")).select("well_id", F.col("m.tvt_input").alias("anchor"), F.col("m.row_id").alias("at"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; rows later than `late` behind the newest are left out (append mode)."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
