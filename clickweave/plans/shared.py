"""Intermediate results that several reports of one run read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, given: str | None, name: str) -> str:
    """``given``, or a folder of this name below the one the cluster names for checkpoints."""
    return given or f"{_root(spark, None)}/{name}"


def _root(spark: SparkSession, given: str | None) -> str:
    root = given or spark.conf.get(CHECKPOINT_SETTING, None)
    if not root:
        raise ValueError(f"no shared folder: pass one or set {CHECKPOINT_SETTING}")
    return root.rstrip("/")


def shared_table(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written once to ``<folder>/<name>`` and read back: later plans start from the files, not from the inputs.

    It fails where that table exists: it belongs to another run, which may still be reading it.
    """
    spark = df.sparkSession
    path = f"{_root(spark, folder)}/{name}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_shared(spark: SparkSession, name: str, folder: str | None = None) -> None:
    """Removes a shared table, and nothing else in its folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{_root(spark, folder)}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
