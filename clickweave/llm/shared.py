"""What several operators of this subpackage need: inputs and intermediate tables."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHECKPOINT_SETTING = "spark.checkpoint.dir"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a session without that setting gets one in its warehouse."""
    root = spark.conf.get(CHECKPOINT_SETTING, None)
    return root.rstrip("/") if root else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def materialized(df: DataFrame, name: str, partition_by: str | None = None, codec: str | None = None) -> DataFrame:
    """``df`` written once below the shared folder and read back, so lost executors cost no recomputation.

    Every call writes to a path of its own; nothing is overwritten. ``codec`` is the files' compression, the session's if not given.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec) if codec else df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, size: str) -> Iterator[None]:
    """What runs inside hands rows to Python in batches of about this size, for rows that are large themselves."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def give_memory_back() -> None:
    """What this process has freed, and its allocators still hold, goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def in_arrow(df: DataFrame, function: Callable[[Iterator], Iterator], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` whose workers, which later tasks use again, hold no memory of a task that has ended."""

    def task(batches):
        try:
            yield from function(batches)
        finally:
            give_memory_back()

    return df.mapInArrow(task, schema)


def rows_in_arrow(df: DataFrame, function: Callable[[Iterator], Iterator]) -> DataFrame:
    """``df.mapInArrow`` for rows that keep their columns; where names hold dots, the function sees numbered ones."""
    if not any(sign in name for name in df.columns for sign in ".`"):
        return in_arrow(df, function, df.schema)
    numbered = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return in_arrow(numbered, function, numbered.schema).toDF(*df.columns)


def workers_find_package(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it, unless they have it installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))
