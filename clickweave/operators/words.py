"""Word count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def words(lines: DataFrame, column: str = "value") -> DataFrame:
    """Space-separated words of every line; empty words are dropped."""
    parts = F.split(F.replace(F.col(column), F.lit("\n"), F.lit(" ")), " ")
    return lines.select(F.explode(parts).alias("word")).where(F.col("word") != "")


def word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """Occurrences per word."""
    return words(lines, column).groupBy("word").agg(F.count("*").alias("count"))
