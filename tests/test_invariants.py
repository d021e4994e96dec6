"""Relations between results that hold for any input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from clickweave.catalog import SAMPLE_TOTAL

QUERIES = spark_entry.queries()


@pytest.fixture(scope="module")
def result(spark, small_dir):
    cache = {}

    def get(name):
        if name not in cache:
            cache[name] = QUERIES[name](spark, small_dir).cache()
        return cache[name]

    yield get
    for df in cache.values():
        df.unpersist()


def test_buckets_add_up(result):
    row = result("session_buckets").first().asDict()
    assert sum(v for k, v in row.items() if k.startswith("step")) == row["session_count"]
    assert sum(v for k, v in row.items() if k.startswith("visit")) <= row["session_count"]
    assert result("session_hour_counts").agg(F.sum("session_count")).first()[0] == row["session_count"]
    assert result("session_filter").count() == row["session_count"]


def test_sample_is_a_subset_without_repeats(result):
    sample = result("session_sample")
    assert sample.count() == sample.select("sessionid").distinct().count() <= SAMPLE_TOTAL
    kept = result("session_filter").withColumnRenamed("session_id", "sessionid")
    assert sample.join(kept, "sessionid", "left_anti").count() == 0
    detail = result("session_sample_detail")
    assert detail.select("sessionid").distinct().count() == sample.count()


def test_accepted_and_later_clicks_are_all_clicks(result, spark, small_dir):
    from clickweave.catalog import AD_THRESHOLD
    from clickweave.operators import ads
    from clickweave.plans.skew import HotKeys
    from clickweave.sources import testdata

    clicks = testdata.ad_click(spark, small_dir)
    for threshold in (1, 2, AD_THRESHOLD, 10_000):
        accepted = ads.accepted_clicks(clicks, threshold, HotKeys("userid"))
        assert accepted.join(clicks, "event_id", "left_anti").count() == 0
        listed = ads.blacklist(ads.user_daily(clicks), threshold)
        # Users that are never listed keep every click; a listed user keeps at least the threshold.
        free = clicks.join(listed, "userid", "left_anti").count()
        assert accepted.join(listed, "userid", "left_anti").count() == free
        per_user = accepted.join(listed, "userid", "left_semi").groupBy("userid").count()
        assert per_user.where(F.col("count") < threshold).count() == 0
        assert per_user.count() == listed.count()


def test_ad_totals_agree(result, spark, small_dir):
    from clickweave.sources import testdata

    clicks = testdata.ad_click(spark, small_dir).count()
    for name in ("ad_user_daily", "ad_city_daily", "ad_province_daily", "ad_minute_trend"):
        assert result(name).agg(F.sum("clickCount")).first()[0] == clicks
    assert result("ad_hour_sliding").agg(F.sum("clickCount")).first()[0] == 60 * clicks


def test_page_pairs_and_sessions_cover_all_actions(result):
    sessions = result("session_rollup")
    steps = sessions.agg(F.sum("step_length")).first()[0]
    assert result("page_pairs").count() == steps - sessions.count() and steps == result("action_scan").count()


def test_categories_of_top_lists_exist(result):
    universe = result("category_universe")
    counts = result("category_counts")
    assert universe.count() == counts.count()
    top = result("top10_category").select(F.col("categoryid").alias("category_id"))
    assert top.count() == 10 and top.join(universe, "category_id", "left_anti").count() == 0
    listed = result("top10_category_sessions").select(F.col("categoryid").alias("category_id")).distinct()
    assert listed.join(top, "category_id", "left_anti").count() == 0
