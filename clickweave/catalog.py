"""The operators as named queries over the test tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickweave.functions.aggregates import group_concat_distinct
from clickweave.functions import scalars
from clickweave.functions.scalars import concat_id_name, format_time, kv_get, kv_set
from clickweave.operators import ads, areas, categories, pageflow, sessions, words
from clickweave.params import TaskParams
from clickweave.plans import jobs
from clickweave.plans.skew import find_hot_keys
from clickweave.sources import ad_lines, testdata
from clickweave.sources.warehouse import (
    action_rejects,
    action_scan,
    action_scan_by_time,
    area_click_scan,
    list_rejects,
    load_actions,
)

TASK = "task-1"
SAMPLE_TOTAL, SAMPLE_SEED = 100, "42"
LARGE_SAMPLE_TOTAL = 1000
AD_THRESHOLD = 5
#: Rows from which the queries named ..._hot count a key as heavy: low enough for the test tables.
HOT_ROWS = 20

_PERIOD = {"startDate": "2024-01-05", "endDate": "2024-01-20", "startAge": 20, "endAge": 50,
           "targetPageFlow": "1,2,3,4,5,6,7"}
PARAMS = TaskParams.from_dict(_PERIOD)
NARROW = TaskParams.from_dict({**_PERIOD, "sex": "male", "keywords": "kw1,kw2", "categoryIds": "5,10,15"})
PLACES = TaskParams.from_dict({**_PERIOD, "professionals": ",".join(f"professional{i}" for i in range(0, 100, 2)),
                               "cities": ",".join(f"city{i}" for i in range(13))})

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ACTION_COLUMNS = (
    "date", "user_id", "session_id", "page_id", "action_time", "search_keyword", "click_category_id",
    "click_product_id", "order_category_ids", "order_product_ids", "pay_category_ids", "pay_product_ids",
    "city_id", "event_id",
)


def _query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def _query_named(name: str) -> Callable[[Query], Query]:
    """For queries whose own name is that of an imported function."""
    def register(fn: Query) -> Query:
        _QUERIES[name] = fn
        return fn
    return register


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# ---- inputs ---------------------------------------------------------------------------------

def _all_actions(spark, sf):
    return load_actions(testdata.user_visit_action(spark, sf))


def _actions(spark, sf):
    return action_scan(_all_actions(spark, sf), PARAMS)


def _kept(spark, sf, params=PARAMS):
    return sessions.kept_sessions(_actions(spark, sf), testdata.user_info(spark, sf), params)


def _text(array: str):
    return F.array_join(array, ",").alias(array)


# ---- scans ----------------------------------------------------------------------------------

@_query_named("action_scan")
def action_scan_rows(spark, sf):
    return _actions(spark, sf).select(*_ACTION_COLUMNS)


@_query_named("action_scan_by_time")
def action_scan_by_time_rows(spark, sf):
    return action_scan_by_time(_all_actions(spark, sf), PARAMS).select(*_ACTION_COLUMNS)


@_query_named("area_click_scan")
def area_click_scan_rows(spark, sf):
    return area_click_scan(_all_actions(spark, sf), PARAMS)


@_query
def city_area_dim(spark, sf):
    return testdata.city_area(spark, sf)


# ---- sessions -------------------------------------------------------------------------------

@_query
def session_rollup(spark, sf):
    return sessions.session_rollup(_actions(spark, sf)).select(
        "session_id", "user_id", format_time(F.col("start_ts")).alias("start_time"),
        format_time(F.col("end_ts")).alias("end_time"), "visit_length", "step_length",
        _text("search_keywords"), _text("click_category_ids"))


def _profile_columns(profile):
    return profile.select(
        "session_id", "user_id", format_time(F.col("start_ts")).alias("start_time"), "visit_length",
        "step_length", _text("search_keywords"), _text("click_category_ids"),
        "age", "professional", "sex", "user_city")


@_query
def session_profile(spark, sf):
    rollup = sessions.session_rollup(_actions(spark, sf))
    return _profile_columns(sessions.session_profile(rollup, testdata.user_info(spark, sf)))


def _filtered_profile(spark, sf, params):
    rollup = sessions.session_rollup(_actions(spark, sf), params)
    profile = sessions.session_profile(rollup, testdata.user_info(spark, sf))
    return _profile_columns(sessions.session_filter(profile, params))


@_query
def session_filter(spark, sf):
    return _filtered_profile(spark, sf, PARAMS)


@_query
def session_filter_narrow(spark, sf):
    return _filtered_profile(spark, sf, NARROW)


@_query
def session_filter_places(spark, sf):
    return _filtered_profile(spark, sf, PLACES)


@_query
def filtered_actions(spark, sf):
    return sessions.filtered_actions(_actions(spark, sf), _kept(spark, sf)).select(*_ACTION_COLUMNS)


@_query
def filtered_actions_hot(spark, sf):
    actions = _actions(spark, sf)
    hot = find_hot_keys(actions, "session_id", HOT_ROWS)
    return sessions.filtered_actions(actions, _kept(spark, sf), hot).select(*_ACTION_COLUMNS)


@_query
def session_buckets(spark, sf):
    return sessions.session_buckets(_kept(spark, sf))


@_query
def session_ratio(spark, sf):
    return jobs.session_aggr_stat(_all_actions(spark, sf), testdata.user_info(spark, sf), PARAMS, TASK)


@_query
def session_hour_counts(spark, sf):
    return sessions.session_hour_counts(_kept(spark, sf))


@_query
def session_sample(spark, sf):
    return jobs.session_random_extract(_all_actions(spark, sf), testdata.user_info(spark, sf), PARAMS, TASK,
                                       SAMPLE_TOTAL, SAMPLE_SEED)


@_query
def session_sample_detail(spark, sf):
    return jobs.session_detail(_all_actions(spark, sf), testdata.user_info(spark, sf), PARAMS, TASK,
                               SAMPLE_TOTAL, SAMPLE_SEED)


@_query
def session_sample_1000(spark, sf):
    return jobs.session_random_extract(_all_actions(spark, sf), testdata.user_info(spark, sf), PARAMS, TASK,
                                       LARGE_SAMPLE_TOTAL, SAMPLE_SEED)


@_query
def session_sample_detail_1000(spark, sf):
    return jobs.session_detail(_all_actions(spark, sf), testdata.user_info(spark, sf), PARAMS, TASK,
                               LARGE_SAMPLE_TOTAL, SAMPLE_SEED)


# ---- categories -----------------------------------------------------------------------------

@_query
def category_universe(spark, sf):
    return categories.category_universe(action_scan_by_time(_all_actions(spark, sf), PARAMS))


@_query
def category_counts(spark, sf):
    return categories.category_counts(action_scan_by_time(_all_actions(spark, sf), PARAMS))


@_query
def category_counts_raw(spark, sf):
    return categories.category_counts(action_scan_by_time(load_actions(testdata.raw_actions(spark, sf)), PARAMS))


@_query_named("action_rejects")
def action_rejects_rows(spark, sf):
    return action_rejects(testdata.raw_actions(spark, sf)).select("event_id", "user_id", "action_time", "unreadable")


@_query
def action_list_rejects(spark, sf):
    return list_rejects(testdata.raw_actions(spark, sf))


@_query
def top10_category(spark, sf):
    return jobs.top10_category(_all_actions(spark, sf), PARAMS, TASK)


@_query
def top10_category_sessions(spark, sf):
    return jobs.top10_session(_all_actions(spark, sf), testdata.user_info(spark, sf), PARAMS, TASK)


# ---- page flow ------------------------------------------------------------------------------

@_query
def page_pairs(spark, sf):
    return pageflow.page_pairs(_actions(spark, sf))


@_query
def page_pairs_hot(spark, sf):
    actions = _actions(spark, sf)
    return pageflow.page_pairs(actions, find_hot_keys(actions, "session_id", HOT_ROWS))


def _flow(spark, sf):
    return pageflow.page_flow(pageflow.next_pages(_actions(spark, sf)), PARAMS.target_page_flow)


@_query
def page_flow_counts(spark, sf):
    return _flow(spark, sf).select("step", "page_split", "page_count")


@_query
def page_flow_rate(spark, sf):
    return pageflow.page_flow_rates(_flow(spark, sf))


@_query
def page_flow_rate_string(spark, sf):
    return jobs.page_split_convert_rate(_all_actions(spark, sf), PARAMS, TASK)


# ---- areas ----------------------------------------------------------------------------------

def _area_clicks(spark, sf):
    return area_click_scan(_all_actions(spark, sf), PARAMS)


@_query
def area_click_base(spark, sf):
    return areas.area_click_base(_area_clicks(spark, sf), testdata.city_area(spark, sf))


@_query
def area_product_clicks(spark, sf):
    return areas.area_product_clicks(_area_clicks(spark, sf), testdata.city_area(spark, sf))


@_query
def area_product_info(spark, sf):
    return areas.area_product_info(area_product_clicks(spark, sf), testdata.product_info(spark, sf))


@_query
def area_top3(spark, sf):
    return jobs.area_top3_product(
        _all_actions(spark, sf), testdata.city_area(spark, sf), testdata.product_info(spark, sf), PARAMS, TASK,
        testdata.REGION_LEVELS)


@_query_named("group_concat_distinct")
def group_concat_distinct_cities(spark, sf):
    city = concat_id_name(F.col("city_id"), F.col("city_name"))
    return group_concat_distinct(area_click_base(spark, sf), ["area"], city, "city_info")


# ---- ads ------------------------------------------------------------------------------------

@_query
def ad_parse(spark, sf):
    return ad_lines.ad_parse(testdata.ad_line(spark, sf)).drop("ts")


@_query
def ad_user_daily(spark, sf):
    return ads.user_daily(testdata.ad_click(spark, sf))


@_query
def ad_blacklist(spark, sf):
    return ads.blacklist(ad_user_daily(spark, sf), AD_THRESHOLD)


def _click_columns(clicks):
    return clicks.select("event_id", "province", "city", "userid", "adid")


@_query
def ad_filter_blacklist(spark, sf):
    clicks = testdata.ad_click(spark, sf)
    return _click_columns(ads.without_blacklisted(clicks, ad_blacklist(spark, sf), spread=["event_id"]))


@_query
def ad_accepted_clicks(spark, sf):
    return _click_columns(ads.accepted_clicks(testdata.ad_click(spark, sf), AD_THRESHOLD))


@_query
def ad_accepted_clicks_hot(spark, sf):
    clicks = testdata.ad_click(spark, sf)
    return _click_columns(ads.accepted_clicks(clicks, AD_THRESHOLD, find_hot_keys(clicks, "userid", HOT_ROWS)))


@_query
def ad_city_daily(spark, sf):
    return ads.city_daily(testdata.ad_click(spark, sf))


@_query
def ad_province_daily(spark, sf):
    return ads.province_daily(ad_city_daily(spark, sf))


@_query
def ad_province_top3(spark, sf):
    return ads.province_top(ad_province_daily(spark, sf))


@_query
def ad_minute_trend(spark, sf):
    return ads.minute_trend(testdata.ad_click(spark, sf))


@_query
def ad_hour_sliding(spark, sf):
    return ads.hour_sliding(testdata.ad_click(spark, sf))


# ---- text -----------------------------------------------------------------------------------

@_query
def word_count(spark, sf):
    return words.word_count(testdata.table(spark, sf, "documents"), "text")


def _packed(spark, sf):
    packed = F.concat_ws(
        "|", F.concat(F.lit("sessionid="), F.col("session_id")),
        F.concat(F.lit("searchKeywords="), F.coalesce("search_keyword", F.lit(""))),
        F.concat(F.lit("clickCategoryIds="), F.col("click_category_id").cast("string")))
    return _all_actions(spark, sf).select("event_id", packed.alias("packed"))


@_query
def kv_field_get(spark, sf):
    return _packed(spark, sf).select(
        "event_id", kv_get(F.col("packed"), "sessionid").alias("sessionid"),
        kv_get(F.col("packed"), "searchKeywords").alias("search_keywords"),
        kv_get(F.col("packed"), "clickCategoryIds").alias("click_category_ids"))


@_query
def kv_field_set(spark, sf):
    return _packed(spark, sf).select(
        "event_id", kv_set(F.col("packed"), "clickCategoryIds", "0").alias("packed"))


@_query
def scalar_functions(spark, sf):
    time, ts, noon = F.col("action_time"), F.col("action_ts"), F.lit("2024-01-10 12:00:00")
    return _all_actions(spark, sf).select(
        "event_id",
        scalars.trim_comma(F.concat(F.lit(","), F.col("session_id"), F.lit(",,"))).alias("trimmed"),
        scalars.pad2(F.col("page_id")).alias("padded"),
        scalars.is_empty(F.col("search_keyword")).alias("no_keyword"),
        scalars.is_not_empty(F.col("search_keyword")).alias("keyword"),
        scalars.time_before(time, noon).alias("before_noon"),
        scalars.time_after(time, noon).alias("after_noon"),
        scalars.format_date(ts).alias("day"),
        scalars.date_hour(ts).alias("day_hour"),
        scalars.format_date_key(ts).alias("day_key"),
        scalars.format_date(scalars.parse_date_key(scalars.format_date_key(ts))).alias("day_again"),
        scalars.format_time_minute(ts).alias("minute"),
        scalars.format_double(F.col("event_id") / 8, 2).alias("eighth"),
        (scalars.yesterday_date() < scalars.today_date()).alias("days_pass"),
    )
