"""Scans of the warehouse tables.

The scans take a DataFrame (a table, a Parquet directory, a view) and add only projections and
predicates on stored columns, so both reach the file scan; a table partitioned by ``date`` is
pruned by the same predicate. ``action_scan_by_time`` filters the stored text of the time: where it can be
read its date prefix has a fixed width, so the range of the text is that of the time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickweave.functions.scalars import parse_action_time
from clickweave.params import TaskParams
from clickweave.schemas import CITY_AREA, PRODUCT_INFO, USER_INFO, USER_VISIT_ACTION

NO_CLICK = -1
CATEGORY_LISTS = ("order_category_ids", "pay_category_ids")

# The ten cities of the original city dimension (id, name, area).
CITY_AREA_ROWS = (
    (0, "北京", "华北"), (1, "上海", "华东"), (2, "南京", "华东"), (3, "广州", "华南"), (4, "三亚", "华南"),
    (5, "武汉", "华中"), (6, "长沙", "华中"), (7, "西安", "西北"), (8, "成都", "西南"), (9, "哈尔滨", "东北"),
)
# Level of an area in the original report; every other area is "D Level".
AREA_LEVELS = {
    "A Level": ("华北", "华东"),
    "B Level": ("华南", "华中"),
    "C Level": ("西南", "西北"),
}


def typed(df: DataFrame, ddl: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``ddl`` cast to its types, plus any of ``extra`` that exist; unreadable values become null."""
    fields = [f.strip().split(" ") for f in ddl.split(",")]
    kept = [c for c in extra if c in df.columns]
    stored = dict(df.dtypes)
    return df.select(*[F.col(name) if stored[name] == kind or (name, stored[name]) == ("date", "date")
                       else F.col(name).try_cast(kind).alias(name) for name, kind in fields], *kept)


def load_actions(df: DataFrame) -> DataFrame:
    """``user_visit_action`` with declared types and ``action_ts``. An ``event_id``, where the table
    has one, orders actions of the same second; otherwise a hash of what the page order depends on
    does, repeatably and without reading the other columns. A ``date`` stored as DATE stays one, so that its
    range is pushed down. What cannot be read is null; ``action_rejects`` lists such rows."""
    actions = typed(df, USER_VISIT_ACTION, ("event_id",))
    if "event_id" not in actions.columns:
        actions = actions.withColumn("event_id", F.xxhash64("session_id", "action_time", "page_id"))
    return actions.withColumn("action_ts", parse_action_time(F.col("action_time")))


def action_rejects(df: DataFrame) -> DataFrame:
    """Rows of ``user_visit_action`` that jobs by time or by id lose, with the columns that cannot be read.

    The time must be there; ids may be null, but where they are given they must be numbers.
    """
    fields = [f.strip().split(" ") for f in USER_VISIT_ACTION.split(",")]
    stored = dict(df.dtypes)
    unreadable = [F.when(parse_action_time(F.col("action_time").cast("string")).isNull(), F.lit("action_time"))]
    unreadable += [F.when(F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull(), F.lit(name))
                   for name, kind in fields if stored[name] != kind and kind != "string"]
    return df.withColumn("unreadable", F.concat_ws(",", *unreadable)).where(F.col("unreadable") != "")


def list_rejects(df: DataFrame, columns: Sequence[str] = CATEGORY_LISTS) -> DataFrame:
    """Entries of the comma lists that are no numbers and so count for no category: event_id, list_column, entry, a row for each."""
    lists = F.array(*[F.struct(F.lit(c).alias("list_column"), F.split(F.col(c), ",").alias("entries")) for c in columns])
    entries = df.select("event_id", F.explode(lists).alias("list")).select(
        "event_id", "list.list_column", F.explode("list.entries").alias("entry"))
    return entries.where(F.col("entry").try_cast("bigint").isNull())


def load_users(df: DataFrame) -> DataFrame:
    return typed(df, USER_INFO)


def load_products(df: DataFrame) -> DataFrame:
    return typed(df, PRODUCT_INFO)


def city_area_dim(spark: SparkSession, rows=CITY_AREA_ROWS) -> DataFrame:
    """City dimension from literal rows; small enough that Spark broadcasts it by its own size check."""
    return spark.createDataFrame(list(rows), CITY_AREA)


def action_scan(actions: DataFrame, params: TaskParams) -> DataFrame:
    """Actions with ``start_date <= date <= end_date``."""
    if params.start_date:
        actions = actions.where(F.col("date") >= params.start_date)
    if params.end_date:
        actions = actions.where(F.col("date") <= params.end_date)
    return actions


def action_scan_by_time(actions: DataFrame, params: TaskParams, date_of_time: bool = False) -> DataFrame:
    """Actions whose time lies in the date range; the whole last day is included.

    ``date_of_time`` states that the table's ``date`` is the date of its time: the range of dates is then added, which
    prunes the partitions of a table partitioned by ``date``.
    """
    if date_of_time:
        actions = action_scan(actions, params)
    if params.start_date:
        actions = actions.where(F.col("action_time") >= params.start_date)
    if params.end_date:
        after = (dt.date.fromisoformat(params.end_date) + dt.timedelta(days=1)).isoformat()
        actions = actions.where(F.col("action_time") < after)
    if params.start_date or params.end_date:
        actions = actions.where(F.col("action_ts").isNotNull())
    return actions


def area_click_scan(actions: DataFrame, params: TaskParams) -> DataFrame:
    """(click_product_id, city_id) of the clicks in the date range."""
    clicks = action_scan(actions, params).where(
        F.col("click_product_id").isNotNull() & (F.col("click_product_id") != NO_CLICK)
    )
    return clicks.select("click_product_id", "city_id")
