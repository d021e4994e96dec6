"""Category universe, click/order/pay counts and the top lists built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickweave.functions.scalars import csv_values
from clickweave.sources.warehouse import NO_CLICK

CLICK, ORDER, PAY = 0, 1, 2


def category_events(actions: DataFrame, *more: str) -> DataFrame:
    """One row (kind, category_id and the columns ``more``) per action and distinct category it clicks, orders or pays for.

    One scan serves all three kinds: the lists of an action are unfolded by kind, then by value.
    """
    clicked = F.when(F.col("click_category_id") != NO_CLICK, F.array(F.col("click_category_id")))
    lists = F.array(clicked, csv_values(F.col("order_category_ids")), csv_values(F.col("pay_category_ids")))
    by_kind = actions.select(*more, F.posexplode(lists).alias("kind", "ids")).where(F.col("ids").isNotNull())
    return by_kind.select("kind", *more, F.explode("ids").alias("category_id")).where(F.col("category_id").isNotNull())


def category_universe(actions: DataFrame) -> DataFrame:
    """Distinct categories that were clicked, ordered or paid for."""
    return category_events(actions).select("category_id").distinct()


def category_counts(actions: DataFrame) -> DataFrame:
    """Clicks, orders and payments of every category, 0 where a kind is missing."""
    kind = F.col("kind")
    return category_events(actions).groupBy("category_id").agg(
        F.count_if(kind == CLICK).alias("click_count"),
        F.count_if(kind == ORDER).alias("order_count"),
        F.count_if(kind == PAY).alias("pay_count"),
    )


def session_category_counts(actions: DataFrame) -> DataFrame:
    """Events per (kind, category_id, session_id): the totals of the categories and the clicks of the sessions are both sums of these."""
    return category_events(actions, "session_id").groupBy("kind", "category_id", "session_id").agg(F.count("*").alias("n"))


def category_totals(counts: DataFrame) -> DataFrame:
    """``category_counts`` from ``session_category_counts``."""
    n, kind = F.col("n"), F.col("kind")
    return counts.groupBy("category_id").agg(*[
        F.coalesce(F.sum(F.when(kind == value, n)), F.lit(0)).alias(name)
        for value, name in ((CLICK, "click_count"), (ORDER, "order_count"), (PAY, "pay_count"))])


def top_categories(counts: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` categories with most clicks, then orders, then payments, then the smallest id."""
    return counts.orderBy(
        F.desc("click_count"), F.desc("order_count"), F.desc("pay_count"), "category_id").limit(k)


def top_category_sessions(counts: DataFrame, kept: DataFrame, top: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` kept sessions with most clicks in each of the ``top`` categories.

    ``counts`` are ``session_category_counts``; ``top`` can be made of the same ones, and Spark then shuffles them once for both uses.
    They are joined before the kept sessions are looked up, so a very long session is at most one row per top category and kind, and wide
    action rows never move. Spark broadcasts ``top`` by its own check of the size, as ``k`` is the caller's.
    """
    clicks = F.sum(F.when(F.col("kind") == CLICK, F.col("n")))
    of_top = counts.join(top.select("category_id"), "category_id").groupBy("category_id", "session_id").agg(clicks.alias("click_count"))
    # Null-safe, as an equality would also be asked of the counts below and keep them from being shared; no kept session is null here.
    named = kept.where(F.col("session_id").isNotNull()).select(F.col("session_id").alias("kept_id"))
    clicked = of_top.where(F.col("click_count") > 0).join(named, F.col("session_id").eqNullSafe(F.col("kept_id")), "left_semi")
    order = Window.partitionBy("category_id").orderBy(F.desc("click_count"), "session_id")
    return (
        clicked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("category_id", "session_id", "click_count")
    )
