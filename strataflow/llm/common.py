"""Helpers shared by the corpus operators: staged tables, checked broadcasts, salted joins."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows are at most this many and each row is a few fixed-width values.
BROADCAST_ROWS = 500_000
#: The same for rows that hold a list of a few dozen such values.
BROADCAST_LISTS = 50_000
BATCH = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python BATCH bytes at a time, or as many as strataflow.batchBytes says: long texts would else make batches of 64 MB on both sides of the pipe."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("strataflow.batchBytes", str(BATCH)))


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back to the system: workers are used again by later tasks, and the C library would else keep what large arrays took."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = ctypes.CDLL(None)
        glibc = hasattr(libc, "malloc_trim")
        if glibc:
            libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD: arrays from here on are mapped, and unmapped when freed
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if glibc:
                libc.malloc_trim(0)

    return run


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share; a temporary one only where that is unset."""
    bounded_batches(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"file://{tempfile.gettempdir()}/strataflow-shared"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, *tables: DataFrame) -> str:
    """name, or a longer one that no column of the tables has in any case of letters."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lookup_join(rows: DataFrame, small: DataFrame, on: Sequence[str], how: str, salt_by: Sequence[str], salts: int = 16, most: int = BROADCAST_ROWS) -> DataFrame:
    """Join rows with small, a staged table that holds each key once.

    small is broadcast only after counting it (`most` rows, fewer to be given for wide rows). Beyond that both sides are shuffled by the key and a
    salt from salt_by, small being repeated once a salt, so that one hot key is spread over `salts` tasks.
    """
    if small.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(small), list(on), how)
    salt = unused("_salt", rows, small)
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    spread = small.withColumn(salt, F.explode(F.array([F.lit(i) for i in range(salts)])))
    return salted.join(spread, [*on, salt], how).drop(salt)
