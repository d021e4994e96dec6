"""Ad-click statistics and the click-fraud blacklist, in batch form.

``clicks`` has (ts, province, city, userid, adid); the accepted-click operator also needs a column
that orders clicks of the same instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickweave.plans.skew import HotKeys, find_hot_keys, spread_join

DEFAULT_THRESHOLD = 100
WINDOW_MINUTES = 60


def _daily(clicks: DataFrame, *keys: str) -> DataFrame:
    """Clicks per date and ``keys``. Grouping is by the date itself; its text is made per group."""
    counts = clicks.groupBy(F.to_date("ts").alias("date"), *keys).agg(F.count("*").alias("clickCount"))
    return counts.withColumn("date", F.col("date").cast("string"))


def user_daily(clicks: DataFrame) -> DataFrame:
    """Clicks per (date, userid, adid)."""
    return _daily(clicks, "userid", "adid")


def blacklist(user_counts: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Users with at least ``threshold`` clicks on one ad in one day."""
    return user_counts.where(F.col("clickCount") >= threshold).select("userid").distinct()


def without_blacklisted(clicks: DataFrame, blacklisted: DataFrame, hot: HotKeys | None = None,
                        spread: list[str] | None = None) -> DataFrame:
    """Clicks of users that are not blacklisted."""
    hot = find_hot_keys(clicks, "userid") if hot is None else hot
    listed = blacklisted.select("userid").distinct()
    return spread_join(clicks, listed, hot, "left_anti", spread or list(clicks.columns))


def blacklist_times(clicks: DataFrame, threshold: int, hot: HotKeys, tie: str = "event_id") -> DataFrame:
    """Per blacklisted user the time of the click that first brings a (date, ad) count to ``threshold``.

    The k-th click of a group is among the first k clicks of each piece of the group, so a heavy user
    is ranked in pieces first; ``row_number() <= k`` is also applied on the map side by Spark.
    """
    group = ["date", "userid", "adid"]
    ranked = clicks.select(F.to_date("ts").alias("date"), "userid", "adid", "ts", tie)
    if hot:
        pieces = Window.partitionBy(*group, "piece").orderBy("ts", tie)
        ranked = (
            ranked.withColumn("piece", hot.salt(tie))
            .withColumn("n", F.row_number().over(pieces)).where(F.col("n") <= threshold).drop("n", "piece")
        )
    order = Window.partitionBy(*group).orderBy("ts", tie)
    reached = ranked.withColumn("n", F.row_number().over(order)).where(F.col("n") == threshold)
    return reached.groupBy("userid").agg(F.min("ts").alias("listed_at"))


def accepted_clicks(clicks: DataFrame, threshold: int = DEFAULT_THRESHOLD, hot: HotKeys | None = None,
                    tie: str = "event_id") -> DataFrame:
    """Clicks up to the moment their user is blacklisted; later ones do not count.

    The stream decides per micro-batch; this is the same rule decided click by click.
    """
    hot = find_hot_keys(clicks, "userid") if hot is None else hot
    listed = blacklist_times(clicks, threshold, hot, tie)
    joined = spread_join(clicks, listed, hot, "left", [tie])
    return joined.where(F.col("listed_at").isNull() | (F.col("ts") <= F.col("listed_at"))).drop("listed_at")


def city_daily(clicks: DataFrame) -> DataFrame:
    """Clicks per (date, province, city, adid)."""
    return _daily(clicks, "province", "city", "adid")


def province_daily(city_counts: DataFrame) -> DataFrame:
    """Clicks per (date, province, adid), from the city counts."""
    return city_counts.groupBy("date", "province", "adid").agg(F.sum("clickCount").alias("clickCount"))


def province_top(province_counts: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most clicked ads per (date, province); ties go to the smaller ad id."""
    order = Window.partitionBy("date", "province").orderBy(F.desc("clickCount"), "adid")
    return province_counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def minute_counts(clicks: DataFrame) -> DataFrame:
    """Clicks per (minute, adid); ``minute`` is a timestamp."""
    return clicks.groupBy(F.date_trunc("minute", "ts").alias("minute"), "adid").agg(
        F.count("*").alias("clickCount"))


def minute_trend(clicks: DataFrame) -> DataFrame:
    """Clicks per (date, hour, minute, adid), the time as text parts."""
    return minute_counts(clicks).select(
        F.date_format("minute", "yyyyMMdd").alias("date"),
        F.date_format("minute", "HH").alias("hour"),
        F.date_format("minute", "mm").alias("minute"),
        "adid", "clickCount",
    )


def hour_sliding(clicks: DataFrame) -> DataFrame:
    """Clicks per ad in every 60-minute window that starts on a minute and holds a click.

    Instead of repeating counts once per window, each minute with clicks is followed by empty minutes
    up to the next one (at most 59), which are exactly the ends of the windows to report; a range
    frame adds up the hour before each end. The rows of one ad are bounded by the minutes of the
    calendar, not by its clicks.
    """
    by_ad = Window.partitionBy("adid").orderBy("at")
    counts = minute_counts(clicks).select(
        "adid", "clickCount", F.expr("unix_timestamp(minute) div 60").alias("at"))
    limit = F.col("at") + WINDOW_MINUTES
    ends = counts.withColumn("next_at", F.lead("at").over(by_ad)).select(
        "*", F.explode(F.sequence(F.col("at"), F.least("next_at", limit) - 1)).alias("end"))
    last_hour = Window.partitionBy("adid").orderBy("end").rangeBetween(1 - WINDOW_MINUTES, 0)
    own = F.when(F.col("end") == F.col("at"), F.col("clickCount")).otherwise(0)

    def text(minute: Column) -> Column:
        return F.date_format(F.timestamp_seconds(minute * 60), "yyyyMMddHHmm")

    end = F.col("end") + 1
    return ends.withColumn("own", own).select(
        text(end - WINDOW_MINUTES).alias("window_start"), text(end).alias("window_end"),
        "adid", F.sum("own").over(last_hour).alias("clickCount"))
