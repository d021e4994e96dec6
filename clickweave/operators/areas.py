"""Most clicked products per area."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickweave.functions.aggregates import sorted_set
from clickweave.functions.scalars import concat_id_name, json_field
from clickweave.sources.warehouse import AREA_LEVELS


def area_click_base(clicks: DataFrame, cities: DataFrame) -> DataFrame:
    """Clicks with city name and area; clicks in unknown cities drop out. The city table has no
    broadcast hint: Spark broadcasts it when its size allows."""
    return clicks.join(cities, "city_id").select("city_id", "city_name", "area", "click_product_id")


def area_product_clicks(clicks: DataFrame, cities: DataFrame) -> DataFrame:
    """Clicks per (area, product) and the cities they came from, as ``id:name`` joined by commas.

    Clicks are counted per (city, product) first. That collapses a heavy city or product before
    anything is joined, and leaves at most one row per city to the second aggregation. The explicit
    partitioning by product serves that aggregation and a following join with the products.
    """
    per_city = clicks.groupBy("city_id", "click_product_id").agg(F.count("*").alias("n"))
    located = per_city.join(cities, "city_id").select(
        "area", "click_product_id", "n",
        concat_id_name(F.col("city_id"), F.col("city_name")).alias("city"),
    )
    return located.repartition("click_product_id").groupBy("area", "click_product_id").agg(
        F.sum("n").alias("click_count"),
        F.array_join(sorted_set(F.col("city")), ",").alias("city_info"),
    )


def area_product_info(product_clicks: DataFrame, products: DataFrame) -> DataFrame:
    """Product name and status added; clicks of unknown products drop out."""
    status = json_field(F.col("extend_info"), "product_status")
    named = products.select(
        F.col("product_id").alias("click_product_id"), "product_name",
        F.when(status == "0", "Self").otherwise("Third Party").alias("product_status"),
    )
    return product_clicks.join(named, "click_product_id")


def area_level(area: Column, levels: Mapping[str, Sequence[str]] = AREA_LEVELS, default: str = "D Level") -> Column:
    level = F.lit(default)
    for name, areas in levels.items():
        level = F.when(area.isin(list(areas)), name).otherwise(level)
    return level


def area_top_products(product_info: DataFrame, levels: Mapping[str, Sequence[str]] = AREA_LEVELS,
                      k: int = 3) -> DataFrame:
    """The ``k`` most clicked products of each area; ties go to the smaller product id."""
    order = Window.partitionBy("area").orderBy(F.desc("click_count"), "click_product_id")
    return (
        product_info.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .withColumn("area_level", area_level(F.col("area"), levels)).drop("rank")
    )
