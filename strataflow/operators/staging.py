"""Tables written between the steps of a job: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def output_root(spark: SparkSession) -> str:
    """Where jobs put their files: the shared folder that the cluster names in spark.checkpoint.dir; where none is set (one machine), one of their own, which is then set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"file://{tempfile.gettempdir()}/strataflow-shared"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{output_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = fresh_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
