"""Physical plans: pruning, top-k limits, no Python, no cartesian products."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as spark_entry
from clickweave import catalog

QUERIES = {name: query for name, query in spark_entry.queries().items() if name in catalog.all_queries()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text):
    return [set(re.findall(r"(\w+)#", cols)) for cols in re.findall(r"FileScan parquet \[([^\]]*)\]", text)]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cartesian_product(spark, small_dir, name):
    text = plan(QUERIES[name](spark, small_dir))
    for bad in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInArrow"):
        assert bad not in text


@pytest.mark.parametrize("name, limit", [
    ("area_top3", 3), ("ad_province_top3", 3), ("top10_category_sessions", 10), ("session_sample", 100),
    ("ad_accepted_clicks", 5)])
def test_ranked_groups_are_limited_before_the_shuffle(spark, small_dir, name, limit):
    text = plan(QUERIES[name](spark, small_dir))
    assert re.search(rf"WindowGroupLimit .*row_number\(\), {limit}, Partial", text)


def test_global_top_k_needs_no_full_sort(spark, small_dir):
    text = plan(QUERIES["top10_category"](spark, small_dir))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


@pytest.mark.parametrize("name, unread", [
    ("session_ratio", {"event_type", "props", "value"}), ("area_top3", {"value"}),
    ("ad_user_daily", {"event_id", "event_type", "value"}), ("category_counts", {"value"})])
def test_scans_read_only_what_is_used(spark, small_dir, name, unread):
    scans = read_columns(plan(QUERIES[name](spark, small_dir)))
    assert scans and all(not (columns & unread) for columns in scans)


def test_category_counts_scan_once_and_shuffle_once(spark, small_dir):
    text = plan(QUERIES["category_counts"](spark, small_dir))
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1


def test_leading_sessions_scan_the_clicks_once(spark, small_dir):
    df = QUERIES["top10_category_sessions"](spark, small_dir)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    # One scan for the totals and the sessions' clicks, whose shuffle they share, and one for the kept sessions.
    assert len([columns for columns in read_columns(final) if "props" in columns or "event_type" in columns]) <= 2
    assert len([columns for columns in read_columns(final) if "c_custkey" not in columns]) == 2 and "ReusedExchange" in final


def test_page_flow_shuffles_only_the_window(spark, small_dir):
    text = plan(QUERIES["page_flow_counts"](spark, small_dir))
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1


def test_session_counts_build_no_lists(spark, small_dir):
    for name in ("session_ratio", "session_hour_counts", "filtered_actions", "top10_category_sessions"):
        assert "collect_set" not in plan(QUERIES[name](spark, small_dir))


def test_sample_computes_the_sessions_once(spark, small_dir):
    df = QUERIES["session_sample"](spark, small_dir)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    scans = [columns for columns in read_columns(final) if "event_id" in columns or "props" in columns]
    # One scan for the sessions, whose shuffle counts and ranking share, and one for the lists.
    assert len(scans) == 2 and "ReusedExchange" in final


def test_area_clicks_are_counted_before_the_joins(spark, small_dir):
    text = plan(QUERIES["area_top3"](spark, small_dir))
    joined = [line for line in text.splitlines() if "partial_count" in line]
    assert joined and "area" not in joined[0]


def test_predicates_on_stored_columns_reach_the_file_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    from clickweave import schemas
    from clickweave.params import TaskParams
    from clickweave.sources import warehouse

    path = str(tmp_path / "actions")
    rows = [(f"2018-06-{d:02d}", 1, "s", 1, f"2018-06-{d:02d} 6:00:00", None, 1, d, None, None, None, None, 0)
            for d in range(1, 20)]
    spark.createDataFrame(rows, schemas.USER_VISIT_ACTION).write.partitionBy("date").parquet(path)
    actions = warehouse.load_actions(spark.read.schema(schemas.USER_VISIT_ACTION).parquet(path))
    params = TaskParams(start_date="2018-06-03", end_date="2018-06-05")
    clicks = warehouse.area_click_scan(actions, params)
    text = plan(clicks)
    assert "PartitionFilters: [isnotnull(date" in text
    assert "Not(EqualTo(click_product_id,-1))" in text
    assert read_columns(text) == [{"click_product_id", "city_id", "date"}]
    assert sorted(r[0] for r in clicks.select(F.col("click_product_id")).collect()) == [3, 4, 5]


def test_time_range_reaches_the_file_scan(spark, tmp_path):
    from clickweave import schemas
    from clickweave.params import TaskParams
    from clickweave.plans import jobs
    from clickweave.sources import warehouse

    path = str(tmp_path / "actions")
    data = [(f"2018-06-{d:02d}", 1, "s", 1, f"2018-06-{d:02d} {time}", None, d, 1, None, None, None, None, 0)
            for d in range(1, 31) for time in ("6:00:00", "23:59:59")]
    spark.createDataFrame(data, schemas.USER_VISIT_ACTION).write.partitionBy("date").parquet(path)
    actions = warehouse.load_actions(spark.read.schema(schemas.USER_VISIT_ACTION).parquet(path))
    users = spark.createDataFrame([(1, "u", "n", 30, "p", "c", "male")], schemas.USER_INFO)
    params = TaskParams(start_date="2018-06-03", end_date="2018-06-05")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for partitions, plans in ((False, (warehouse.action_scan_by_time(actions, params), jobs.top10_category(actions, params, "t"),
                                       jobs.top10_session(actions, users, params, "t"))),
                              (True, (warehouse.action_scan_by_time(actions, params, True),
                                      jobs.top10_category(actions, params, "t", date_of_time=True)))):
        for df in plans:
            text = plan(df)
            scans = [line for line in text.split("FileScan parquet")[1:] if "action_time" in line.split("]")[0]]
            assert scans
            for scan in scans:
                assert "GreaterThanOrEqual(action_time,2018-06-03)" in scan and "LessThan(action_time,2018-06-06)" in scan
                assert ("PartitionFilters: [isnotnull(date" in scan) == partitions
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert warehouse.action_scan_by_time(actions, params).count() == 6
