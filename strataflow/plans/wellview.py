"""Wells from the event table: one user's events are a well, ordered by time; a curve from two event types is its reference.

WELLS_SQL and CURVE_SQL are the same views in DuckDB's dialect, for oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataflow.functions.ordered import Order

WELL = Order(("well_id",), ("row_id",))
KNOWN_SHARE = 0.26


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """well_id, row_id, n, tvt, tvt_input (known prefix), gr (with gaps), md, x, y, z."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    all_rows = Window.partitionBy("user_id")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    us = F.expr("unix_micros(cast(ts as timestamp))")
    running = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("value")).otherwise(0.0)).over(so_far)
    rows = events(spark, sf_dir).select("user_id", "event_id", "ts", "event_type", "value")
    placed = rows.select(
        F.col("user_id").cast("string").alias("well_id"),
        (F.row_number().over(by) - 1).cast("long").alias("row_id"),
        F.count("*").over(all_rows).alias("n"),
        F.col("value").alias("tvt"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("gr"),
        ((us - F.min(us).over(all_rows)) / 1e6).alias("md"),
        running("click").alias("x"),
        running("view").alias("y"),
        running("purchase").alias("z"),
    )
    return placed.withColumn("tvt_input", F.when(F.col("row_id") < F.floor(F.col("n") * KNOWN_SHARE), F.col("tvt")))


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """well_id, ctvt (unique within a well), cgr: the reference curve."""
    rows = events(spark, sf_dir).filter(F.col("event_type").isin("purchase", "signup"))
    return rows.groupBy(F.col("user_id").cast("string").alias("well_id"), F.col("value").alias("ctvt")).agg(F.min(F.col("event_id") % 200).cast("double").alias("cgr"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, px, py, surface: scattered points."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("pid"), F.element_at("embedding", 1).cast("double").alias("px"), F.element_at("embedding", 2).cast("double").alias("py"), F.col("label").cast("double").alias("surface"))


WELLS_SQL = """
e AS (SELECT user_id, event_id, ts, event_type, value, epoch_us(ts) AS us,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
w0 AS (SELECT CAST(user_id AS VARCHAR) AS well_id, CAST(rn AS BIGINT) AS row_id, n, value AS tvt,
        CASE WHEN event_type <> 'error' THEN value END AS gr, (us - min(us) OVER (PARTITION BY user_id)) / 1e6 AS md,
        sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn) AS x,
        sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn) AS y,
        sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn) AS z FROM e),
w AS (SELECT *, CASE WHEN row_id < floor(n * 0.26) THEN tvt END AS tvt_input FROM w0)
"""

CURVE_SQL = """
c AS (SELECT CAST(user_id AS VARCHAR) AS well_id, value AS ctvt, CAST(min(event_id % 200) AS DOUBLE) AS cgr
      FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY user_id, value)
"""

POINTS_SQL = """
p AS (SELECT vec_id AS pid, CAST(embedding[1] AS DOUBLE) AS px, CAST(embedding[2] AS DOUBLE) AS py, CAST(label AS DOUBLE) AS surface FROM embeddings)
"""

#: Frames of one well, for oracles: OVER (o ...) is written with these.
BY = "PARTITION BY well_id ORDER BY row_id"
SO_FAR = f"{BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
ONWARD = f"{BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
WHOLE = f"{BY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def previous_sql(x: str) -> str:
    return f"last_value({x} IGNORE NULLS) OVER ({SO_FAR})"


def following_sql(x: str) -> str:
    return f"first_value({x} IGNORE NULLS) OVER ({ONWARD})"
