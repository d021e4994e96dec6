"""Aggregate expressions and list-building aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_set(col: Column) -> Column:
    """Distinct non-null values in ascending order."""
    return F.array_sort(F.collect_set(col))


def group_concat_distinct(df: DataFrame, keys: list[str], value: Column, name: str, sep: str = ",") -> DataFrame:
    """Distinct text values per group, sorted and joined by ``sep``.

    The values are made distinct by a first aggregation on (keys, value), so a group with very many
    rows is spread over the shuffle and the second step sees one row per distinct value.
    """
    distinct = df.select(*keys, value.alias(name)).distinct()
    return distinct.groupBy(*keys).agg(F.array_join(sorted_set(F.col(name)), sep).alias(name))


def count_between(column: str, low: int, high: int | None) -> Column:
    """Number of rows with ``low <= column <= high``; ``high=None`` is open."""
    return F.expr(f"count_if({column} >= {low})" if high is None else f"count_if({column} BETWEEN {low} AND {high})")
