"""Counts of what passes through a job's stages, taken while the rows pass, and the stages' times.

A stage is watched by `Stages.watch`: its counts are Spark's observed metrics, so they cost no further pass and nothing
is collected but one row of numbers a stage. They are known when the watched rows have been written or read once;
`Stages.staged` writes a stage's rows to the shared folder and takes its time. A plan that reads the watched rows twice
would count its first run only, so stages that are used again are staged.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strataflow.operators.staging import staged


class Stages:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.observed: dict[str, Observation] = {}
        self.seconds: dict[str, float] = {}

    def watch(self, rows: DataFrame, stage: str, **metrics: Column) -> DataFrame:
        """rows, whose number (rows) and other aggregates are counted as they pass."""
        if stage in self.observed:
            raise ValueError(f"stage {stage!r} is watched already")
        self.observed[stage] = Observation()
        return rows.observe(self.observed[stage], F.count(F.lit(1)).alias("rows"), *(m.cast("long").alias(name) for name, m in metrics.items()))

    def staged(self, rows: DataFrame, stage: str, **metrics: Column) -> DataFrame:
        """watch(), with the rows written to the shared folder and read again."""
        began = time.perf_counter()
        out = staged(self.watch(rows, stage, **metrics), stage)
        self.seconds[stage] = time.perf_counter() - began
        return out

    def table(self) -> DataFrame:
        """stage, metric, value of all stages that have run; waits for those that are running."""
        found = [(stage, name, value) for stage, o in self.observed.items() for name, value in o.get.items()]
        return self.spark.createDataFrame(found, "stage string, metric string, value long")

    def times(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.seconds.items()), "stage string, seconds double")
