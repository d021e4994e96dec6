"""Batch sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def append_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Adds the report rows to a Parquet directory."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None,
                partitions: int = 8, batch_size: int = 10_000) -> None:
    """Adds the report rows to a database table over at most ``partitions`` connections."""
    options = {"batchsize": str(batch_size), "numPartitions": str(partitions), **(properties or {})}
    df.write.jdbc(url, table, mode="append", properties=options)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None,
              key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8) -> DataFrame:
    """A database table; with ``key`` and ``bounds`` it is read in parallel slices of the key."""
    if key is None or bounds is None:
        return spark.read.jdbc(url, table, properties=properties or {})
    return spark.read.jdbc(url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1],
                           numPartitions=partitions, properties=properties or {})


def replace_table(df: DataFrame, table: str, partition_by: tuple[str, ...] = ()) -> None:
    """Drops and rewrites a catalogue table."""
    df.write.mode("overwrite").partitionBy(*partition_by).saveAsTable(table)
