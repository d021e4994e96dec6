"""The job inputs as views over the star-schema test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRST_DAY = "2024-01-01"
# Area levels for the regions that stand in for sales areas.
REGION_LEVELS = {
    "A Level": ("AFRICA", "AMERICA"),
    "B Level": ("ASIA",),
    "C Level": ("EUROPE",),
}


# Columns of the tables read here; a declared schema saves the job that would infer it.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


# Days a session may span by user, days by which its dates are shifted, and seconds of the hour its actions fall in.
_DAYS = "CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 30 END"
_SHIFT = "CASE user_id % 3 WHEN 2 THEN 9 ELSE 0 END"
_SPAN = ("CASE user_id % 8 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 12 WHEN 3 THEN 45 WHEN 4 THEN 90 "
         "WHEN 5 THEN 400 WHEN 6 THEN 1200 ELSE 3500 END")
_CODE = "CAST(get_json_object(props, '$.k') AS INT)"


def user_visit_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr(
        "user_id", "event_id", "event_type", f"{_CODE} AS k",
        "event_id * 31 % 50 + CASE WHEN event_id % 41 = 0 THEN 1000000000 ELSE 0 END AS product",  # some unknown products
        f"CAST(event_id * 37 % {_SPAN} AS INT) AS second",
        f"CAST(date_add(DATE '{FIRST_DAY}', (day(ts) - 1) - (day(ts) - 1) % {_DAYS} + {_SHIFT}) AS STRING) AS date",
    )
    return events.selectExpr(
        "date", "user_id", "concat(user_id, '_', date) AS session_id", "CAST(k % 10 AS BIGINT) AS page_id",
        "concat(date, ' ', user_id % 23, ':', lpad(CAST(second div 60 AS STRING), 2, '0'), ':', "
        "lpad(CAST(second % 60 AS STRING), 2, '0')) AS action_time",
        "CASE WHEN event_type = 'view' THEN concat('kw', k % 10) END AS search_keyword",
        "CAST(CASE WHEN event_type = 'click' THEN k ELSE -1 END AS BIGINT) AS click_category_id",
        "CAST(CASE WHEN event_type = 'click' THEN product ELSE -1 END AS BIGINT) AS click_product_id",
        "CASE WHEN event_type = 'signup' THEN concat(k, ',', (k * 3 + 1) % 100) END AS order_category_ids",
        "CASE WHEN event_type = 'signup' THEN CAST(product AS STRING) END AS order_product_ids",
        "CASE WHEN event_type = 'purchase' THEN concat(k, ',', (k * 7 + 2) % 100) END AS pay_category_ids",
        "CASE WHEN event_type = 'purchase' THEN CAST(product AS STRING) END AS pay_product_ids",
        "CAST(user_id * 7 % 27 AS BIGINT) AS city_id", "event_id",  # two cities are unknown
    )


def raw_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actions as a careless source would deliver them: some times and ids cannot be read, lists repeat numbers."""
    spoilt = {
        "action_time": "CASE WHEN event_id % 97 = 0 THEN substr(action_time, 12) WHEN event_id % 101 = 0 THEN date "
                       "WHEN event_id % 103 = 0 THEN NULL ELSE action_time END",
        "user_id": "CASE WHEN event_id % 89 = 0 THEN 'x' ELSE CAST(user_id AS STRING) END",
        "order_category_ids": "CASE event_id % 4 WHEN 0 THEN concat(page_id, ', ', page_id) WHEN 1 THEN concat('0', page_id, ',', page_id) "
                              "WHEN 2 THEN concat('x,', page_id) ELSE order_category_ids END",
    }
    actions = user_visit_action(spark, sf_dir)
    return actions.selectExpr(*[f"{spoilt[c]} AS {c}" if c in spoilt else c for c in actions.columns])


def user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Shifted ids: the first five users of the actions are unknown.
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey + 5 AS user_id", "concat('user', c_custkey + 5) AS username", "c_name AS name",
        "CAST(c_custkey * 13 % 60 AS INT) AS age", "concat('professional', c_custkey % 100) AS professional",
        "concat('city', c_nationkey) AS city", "CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex",
    )


def product_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id", "p_name AS product_name",
        """concat('{"product_status": ', p_partkey % 2, '}') AS extend_info""",
    )


def city_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nations.join(regions, nations.n_regionkey == regions.r_regionkey).selectExpr(
        "CAST(n_nationkey AS BIGINT) AS city_id", "n_name AS city_name", "r_name AS area")


def ad_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(ts AS TIMESTAMP) AS ts", "CAST(event_id % 10 div 3 AS STRING) AS province",
        "CAST(event_id % 10 AS STRING) AS city", "user_id % 50 AS userid",
        f"CAST({_CODE} % 7 AS BIGINT) AS adid", "event_id",
    )


def ad_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad_click(spark, sf_dir).selectExpr(
        "concat_ws(' ', unix_millis(ts), province, city, userid, adid) AS value", "ts")
