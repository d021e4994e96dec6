"""The batch jobs end to end: input tables and task parameters to a report with its declared schema.

``task_id`` is a literal column given by the caller, so a re-run writes the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickweave.operators import areas, categories, pageflow, sessions
from clickweave.params import TaskParams
from clickweave.plans.shared import shared_table
from clickweave.plans.skew import HotKeys
from clickweave.sources.warehouse import AREA_LEVELS, action_scan, action_scan_by_time, area_click_scan


def _task(task_id: str):
    return F.lit(task_id).alias("taskid")


def kept_name(task_id: str) -> str:
    """Name of the shared table of a run's filtered sessions."""
    return f"kept_sessions_{task_id}"


def session_aggr_stat(actions: DataFrame, users: DataFrame, params: TaskParams, task_id: str) -> DataFrame:
    """Visit-length and step-length distribution of the filtered sessions (one row)."""
    kept = sessions.kept_sessions(action_scan(actions, params), users, params)
    ratios = sessions.session_ratios(sessions.session_buckets(kept))
    return ratios.select(_task(task_id), "*")


def session_random_extract(actions: DataFrame, users: DataFrame, params: TaskParams, task_id: str,
                           total: int = 100, seed: str = "42") -> DataFrame:
    """Stratified sample of the filtered sessions with their keywords and clicked categories."""
    scanned = action_scan(actions, params)
    sample = sessions.sample_sessions(sessions.kept_sessions(scanned, users, params), total, seed)
    return _extract(sessions.sample_with_lists(scanned, sample), task_id)


def _extract(listed: DataFrame, task_id: str) -> DataFrame:
    return listed.select(
        _task(task_id), F.col("session_id").alias("sessionid"), F.col("start_time").alias("startTime"),
        F.nullif(F.array_join("search_keywords", ","), F.lit("")).alias("searchKeywords"),
        F.nullif(F.array_join("click_category_ids", ","), F.lit("")).alias("clickCategoryIds"),
    )


def session_reports(actions: DataFrame, users: DataFrame, params: TaskParams, task_id: str,
                    total: int = 100, seed: str = "42", folder: str | None = None) -> dict[str, DataFrame]:
    """Distribution and sample in one run: the filtered sessions are computed once and shared.

    They are written to a folder of their own below ``folder`` (by default below ``spark.checkpoint.dir``), so
    losing an executor costs no recomputation; ``remove_shared`` removes it once the reports are stored.
    """
    scanned = action_scan(actions, params)
    kept = shared_table(sessions.kept_sessions(scanned, users, params), kept_name(task_id), folder)
    ratios = sessions.session_ratios(sessions.session_buckets(kept))
    sample = sessions.sample_sessions(kept, total, seed)
    return {
        "session_stat": ratios.select(_task(task_id), "*"),
        "session_random_extract": _extract(sessions.sample_with_lists(scanned, sample), task_id),
    }


def session_detail(actions: DataFrame, users: DataFrame, params: TaskParams, task_id: str,
                   total: int = 100, seed: str = "42") -> DataFrame:
    """All actions of the sampled sessions."""
    scanned = action_scan(actions, params)
    sample = sessions.sample_sessions(sessions.kept_sessions(scanned, users, params), total, seed)
    return sessions.sample_detail(scanned, sample).select(
        _task(task_id), F.col("user_id").alias("userid"), F.col("session_id").alias("sessionid"),
        F.col("page_id").alias("pageid"), F.col("action_time").alias("actionTime"),
        F.col("search_keyword").alias("searchKeyword"),
        F.col("click_category_id").alias("clickCategoryId"), F.col("click_product_id").alias("clickProductId"),
        F.col("order_category_ids").alias("orderCategoryIds"), F.col("order_product_ids").alias("orderProductIds"),
        F.col("pay_category_ids").alias("payCategoryIds"), F.col("pay_product_ids").alias("payProductIds"),
    )


def top10_category(actions: DataFrame, params: TaskParams, task_id: str, k: int = 10,
                   date_of_time: bool = False) -> DataFrame:
    """The ten leading categories over all actions of the period."""
    top = categories.top_categories(categories.category_counts(action_scan_by_time(actions, params, date_of_time)), k)
    return top.select(
        _task(task_id), F.col("category_id").alias("categoryid"), F.col("click_count").alias("clickCount"),
        F.col("order_count").alias("orderCount"), F.col("pay_count").alias("payCount"))


def top10_session(actions: DataFrame, users: DataFrame, params: TaskParams, task_id: str, k: int = 10,
                  date_of_time: bool = False) -> DataFrame:
    """The ten filtered sessions with most clicks in each of the ten leading categories."""
    scanned = action_scan_by_time(actions, params, date_of_time)
    counts = categories.session_category_counts(scanned)
    top = categories.top_categories(categories.category_totals(counts), k)
    kept = sessions.kept_sessions(scanned, users, params)
    return categories.top_category_sessions(counts, kept, top, k).select(
        _task(task_id), F.col("category_id").alias("categoryid"),
        F.col("session_id").alias("sessionid"), F.col("click_count").alias("clickCount"))


def page_split_convert_rate(actions: DataFrame, params: TaskParams, task_id: str,
                            hot: HotKeys | None = None) -> DataFrame:
    """One-step conversion rates along the target page flow (one row)."""
    following = pageflow.next_pages(action_scan(actions, params), hot)
    rates = pageflow.page_flow_rate_string(pageflow.page_flow(following, params.target_page_flow))
    return rates.select(_task(task_id), "convertRate")


def area_top3_product(actions: DataFrame, cities: DataFrame, products: DataFrame, params: TaskParams, task_id: str,
                      levels: Mapping[str, Sequence[str]] = AREA_LEVELS, k: int = 3) -> DataFrame:
    """The three most clicked products of each area."""
    clicks = areas.area_product_clicks(area_click_scan(actions, params), cities)
    top = areas.area_top_products(areas.area_product_info(clicks, products), levels, k)
    return top.select(
        _task(task_id), "area", F.col("area_level").alias("areaLevel"),
        F.col("click_product_id").alias("productid"), F.col("city_info").alias("cityInfos"),
        F.col("click_count").alias("clickCount"), F.col("product_name").alias("productName"),
        F.col("product_status").alias("productStatus"))
