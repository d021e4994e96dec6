"""Hand-made cases: boundaries, ties, empty input and malformed values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clickweave import schemas
from clickweave.operators import ads, areas, categories, pageflow, sessions
from clickweave.params import TaskParams
from clickweave.plans import jobs
from clickweave.plans.skew import HotKeys
from clickweave.sources import ad_lines, warehouse

DAY = "2018-06-25"
NONE = HotKeys("session_id")


def act(session="s1", time="6:00:00", user=1, page=1, keyword=None, category=-1, product=-1,
        orders=None, pays=None, city=0, date=DAY):
    return (date, user, session, page, f"{date} {time}", keyword, category, product, orders, None, pays, None, city)


def load(spark, rows):
    return warehouse.load_actions(spark.createDataFrame(rows, schemas.USER_VISIT_ACTION))


def users(spark, rows):
    return spark.createDataFrame([(u, "", "", age, prof, city, sex) for u, age, prof, city, sex in rows],
                                 schemas.USER_INFO)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rollup_keeps_ids_contained_in_others(spark):
    actions = load(spark, [
        act(category=11), act(category=1, time="16:00:00"), act(keyword="hot pot"), act(keyword="hot"),
        act(keyword=""), act(category=11)])
    r = sessions.session_rollup(actions).first()
    assert r["click_category_ids"] == [1, 11]
    assert r["search_keywords"] == ["hot", "hot pot"]
    assert r["step_length"] == 6 and r["visit_length"] == 36000


def test_rollup_and_spans_agree(spark):
    actions = load(spark, [act(session=f"s{i % 3}", time=f"7:{i:02d}:00", user=i % 3, keyword=f"k{i % 2}",
                               category=i) for i in range(30)])
    params = TaskParams(keywords=("k1",), category_ids=(3,))
    common = ["session_id", "user_id", "start_ts", "end_ts", "step_length", "visit_length",
              "keyword_hit", "category_hit"]
    assert rows(sessions.session_rollup(actions, params).select(*common)) == rows(
        sessions.session_spans(actions, params).select(*common))


@pytest.mark.parametrize("seconds, bucket", [
    (0, None), (1, "1s_3s"), (3, "1s_3s"), (4, "4s_6s"), (6, "4s_6s"), (9, "7s_9s"), (10, "10s_30s"),
    (30, "10s_30s"), (31, "30s_60s"), (60, "30s_60s"), (61, "1m_3m"), (180, "1m_3m"), (181, "3m_10m"),
    (600, "3m_10m"), (601, "10m_30m"), (1800, "10m_30m"), (1801, "30m")])
def test_visit_buckets(spark, seconds, bucket):
    kept = spark.sql(f"SELECT CAST({seconds} AS BIGINT) visit_length, CAST(2 AS BIGINT) step_length")
    got = sessions.session_buckets(kept).first().asDict()
    hit = [k for k, v in got.items() if k.startswith("visit") and v]
    assert hit == ([f"visit_length_{bucket}"] if bucket else [])


@pytest.mark.parametrize("steps, bucket", [
    (1, "1_3"), (3, "1_3"), (4, "4_6"), (9, "7_9"), (10, "10_30"), (30, "10_30"), (31, "30_60"), (60, "30_60"),
    (61, "60")])
def test_step_buckets(spark, steps, bucket):
    kept = spark.sql(f"SELECT CAST(0 AS BIGINT) visit_length, CAST({steps} AS BIGINT) step_length")
    got = sessions.session_buckets(kept).first().asDict()
    assert [k for k, v in got.items() if k.startswith("step") and v] == [f"step_length_{bucket}"]


def test_no_session_gives_zero_ratios(spark):
    stat = jobs.session_aggr_stat(load(spark, [act()]), users(spark, []), TaskParams(), "t")
    first = stat.first().asDict()
    assert first.pop("taskid") == "t" and first.pop("session_count") == 0
    assert set(first.values()) == {0.0}
    assert stat.columns == [f.strip().split(" ")[0] for f in schemas.SESSION_AGGR_STAT.split(",")]


def test_filter_combines_every_attribute(spark):
    people = users(spark, [(1, 30, "p1", "c1", "male"), (2, 30, "p2", "c1", "male"), (3, 30, "p1", "c2", "male"),
                           (4, 30, "p1", "c1", "female"), (5, 19, "p1", "c1", "male"), (6, None, "p1", "c1", "male")])
    actions = load(spark, [a for u in range(1, 8) for a in (
        act(session=f"s{u}", user=u, keyword="k"), act(session=f"s{u}", user=u, category=5))]
        + [act(session="other", user=1, keyword="kk", category=5)])
    wide = TaskParams(start_age=20, end_age=50)
    assert rows(sessions.kept_sessions(actions, people, wide).select("session_id")) == [
        ("other",), ("s1",), ("s2",), ("s3",), ("s4",)]
    narrow = TaskParams(start_age=20, end_age=50, professionals=("p1",), cities=("c1", "c9"), sex="male",
                        keywords=("k", "x"), category_ids=(5, 7))
    kept = sessions.kept_sessions(actions, people, narrow)
    assert rows(kept.select("session_id")) == [("s1",)]
    assert sessions.filtered_actions(actions, kept, NONE).count() == 2
    one_bound = TaskParams(start_age=40)
    assert sessions.kept_sessions(actions, people, one_bound).count() == 7


def test_sample_meets_its_quotas(spark):
    starts = [(f"s{i}", f"2024-01-0{1 + i % 2} {i % 5:02d}:00:00") for i in range(400)]
    kept = spark.createDataFrame(starts, "session_id string, t string").select(
        "session_id", F.col("t").cast("timestamp").alias("start_ts"))
    sample = sessions.sample_sessions(kept, total=60, seed="1")
    picked = rows(sample.select("date", "hour", "session_id"))
    assert len({p[2] for p in picked}) == len(picked)
    counts = {}
    for date, hour, _ in picked:
        counts[date, hour] = counts.get((date, hour), 0) + 1
    # 200 sessions a day, 40 per hour, 30 sampled per day: 6 per hour.
    assert set(counts.values()) == {6} and len(counts) == 10
    assert rows(sample) == rows(sessions.sample_sessions(kept.repartition(7), total=60, seed="1", pieces=3))
    assert rows(sample) != rows(sessions.sample_sessions(kept, total=60, seed="2"))
    assert [sessions.sample_sessions(kept, total=n).count() for n in (1, 7, 13, 399)] == [1, 7, 13, 399]
    assert sessions.sample_sessions(kept, total=5000).count() == 400
    assert sessions.sample_sessions(kept.limit(0), total=10).count() == 0


def test_category_counts_per_action(spark):
    actions = load(spark, [
        act(category=7), act(category=7), act(orders="7,8,7"), act(pays="9"), act(pays="7,x,"), act(orders="")])
    assert rows(categories.category_counts(actions)) == [(7, 2, 1, 1), (8, 0, 1, 0), (9, 0, 0, 1)]
    spaced = load(spark, [act(orders="5, 5"), act(orders="05,5"), act(orders="x")])
    assert rows(categories.category_counts(spaced)) == [(5, 0, 2, 0)]
    assert rows(categories.category_universe(actions)) == [(7,), (8,), (9,)]


def test_top_categories_break_ties(spark):
    counts = spark.createDataFrame(
        [(1, 5, 1, 1), (2, 5, 2, 0), (3, 5, 1, 2), (4, 5, 1, 1), (5, 9, 0, 0)],
        "category_id bigint, click_count bigint, order_count bigint, pay_count bigint")
    top = [r["category_id"] for r in categories.top_categories(counts, 4).collect()]
    assert top == [5, 2, 3, 1]


def test_totals_of_session_counts_are_the_category_counts(spark, small_dir):
    from clickweave.sources import testdata
    actions = warehouse.load_actions(testdata.raw_actions(spark, small_dir))
    counts = categories.session_category_counts(actions)
    assert rows(categories.category_totals(counts)) == rows(categories.category_counts(actions))


def test_top_sessions_only_of_kept_sessions(spark):
    actions = load(spark, [act(session=s, category=c) for s, c in
                           [("a", 1), ("a", 1), ("b", 1), ("c", 1), ("d", 1), ("d", 1), ("d", 1), ("a", 2)]])
    kept = spark.createDataFrame([("a",), ("b",), ("c",)], "session_id string")
    top = spark.createDataFrame([(1,)], "category_id bigint")
    counts = categories.session_category_counts(actions)
    assert rows(categories.top_category_sessions(counts, kept, top, 2)) == [(1, "a", 2), (1, "b", 1)]


def test_page_flow_without_a_step_and_single_page_session(spark):
    actions = load(spark, [
        act(page=1, time="6:00:00"), act(page=2, time="6:00:01"), act(page=1, time="16:00:00"),
        act(session="one", page=1)])
    flow = pageflow.page_flow(pageflow.next_pages(actions, NONE), (1, 2, 3, 4, 1))
    assert rows(flow) == [
        (0, "1", 3, None), (1, "1_2", 1, 1 / 3), (2, "2_3", 0, 0.0), (3, "3_4", 0, None), (4, "4_1", 0, None)]
    assert pageflow.page_flow_rate_string(flow).first()[0].startswith("1_2=0.33333")
    assert rows(pageflow.page_pairs(actions, NONE).select("page_id", "next_page_id")) == [(1, 2), (2, 1)]
    with pytest.raises(ValueError):
        pageflow.page_flow(actions, ())


def test_area_report(spark):
    clicks = [act(product=p, city=c) for p, c, n in
              [(1, 1, 2), (1, 2, 1), (2, 1, 3), (3, 2, 1), (4, 1, 1), (5, 0, 2), (9, 0, 9), (6, 99, 5)]
              for _ in range(n)]
    actions = load(spark, clicks + [act(), act(product=None, city=1), act(product=1, city=1, date="2018-07-01")])
    products = spark.createDataFrame(
        [(p, f"p{p}", '{"product_status": %d}' % (p % 2)) for p in range(1, 6)], schemas.PRODUCT_INFO)
    report = jobs.area_top3_product(actions, warehouse.city_area_dim(spark), products,
                                    TaskParams(start_date="2018-06-01", end_date="2018-06-30"), "t")
    assert report.columns == [f.strip().split(" ")[0] for f in schemas.AREA_TOP3_PRODUCT.split(",")]
    assert rows(report.drop("taskid")) == sorted([
        ("华东", "A Level", 1, "1:上海,2:南京", 3, "p1", "Third Party"),
        ("华东", "A Level", 2, "1:上海", 3, "p2", "Self"),
        ("华东", "A Level", 3, "2:南京", 1, "p3", "Third Party"),
        ("华北", "A Level", 5, "0:北京", 2, "p5", "Third Party"),
    ])
    levels = spark.createDataFrame([("华南",), ("西北",), ("东北",)], "a string")
    assert [r[0] for r in levels.select(areas.area_level(F.col("a"))).collect()] == ["B Level", "C Level", "D Level"]


def test_time_scan_includes_the_whole_last_day(spark):
    actions = load(spark, [act(time="23:59:58", date="2018-06-30"), act(time="0:00:00", date="2018-07-01"),
                           act(time="9:00:00", date="2018-06-01")])
    params = TaskParams(start_date="2018-06-01", end_date="2018-06-30")
    assert warehouse.action_scan_by_time(actions, params).count() == 2
    assert warehouse.action_scan(actions, params).count() == 2
    assert warehouse.action_scan(actions, TaskParams()).count() == 3


def test_ad_lines_and_rejects(spark):
    good = ["1530345630266 9 9 4 2", "1530345630266 a b 4 2 extra"]
    bad = ["", "x 9 9 4 2", "1530345630266 9 9 4", "1530345630266 9 9 y 2"]
    lines = spark.createDataFrame([(v,) for v in good + bad], "value string")
    parsed = ad_lines.ad_parse(lines)
    assert rows(parsed.drop("ts")) == [(1530345630266, "9", "9", 4, 2), (1530345630266, "a", "b", 4, 2)]
    assert parsed.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).first()[0] == "2018-06-30 08:00:30"
    assert rows(ad_lines.ad_rejects(lines)) == sorted((v,) for v in bad)


def clicks_of(spark, items):
    return spark.createDataFrame(
        [(i, t, p, c, u, a) for i, (t, p, c, u, a) in enumerate(items)],
        "event_id bigint, t string, province string, city string, userid bigint, adid bigint",
    ).withColumn("ts", F.col("t").cast("timestamp"))


def test_blacklist_threshold_is_inclusive(spark):
    items = [("2024-01-01 10:00:00", "p", "c", u, 1) for u, n in ((1, 3), (2, 2), (3, 4)) for _ in range(n)]
    clicks = clicks_of(spark, items + [("2024-01-02 10:00:00", "p", "c", 2, 1)])
    listed = ads.blacklist(ads.user_daily(clicks), 3)
    assert rows(listed) == [(1,), (3,)]
    assert rows(ads.without_blacklisted(clicks, listed, HotKeys("userid")).select("userid")) == [(2,)] * 3


def test_accepted_clicks_stop_after_the_listing_click(spark):
    clicks = clicks_of(spark, [
        ("2024-01-01 10:00:00", "p", "c", 1, 1), ("2024-01-01 10:00:01", "p", "c", 1, 1),
        ("2024-01-01 10:00:01", "p", "c", 1, 2), ("2024-01-01 10:00:02", "p", "c", 1, 2),
        ("2024-01-03 10:00:00", "p", "c", 1, 3), ("2024-01-01 10:00:00", "p", "c", 2, 1)])
    accepted = ads.accepted_clicks(clicks, 2, HotKeys("userid"))
    assert rows(accepted.select("event_id")) == [(0,), (1,), (2,), (5,)]
    assert accepted.columns == clicks.columns or set(accepted.columns) == set(clicks.columns)


def test_province_leaders_per_day_with_ties(spark):
    counts = spark.createDataFrame(
        [(d, "p", a, n) for d in ("d1", "d2") for a, n in ((4, 1), (3, 5), (2, 5), (1, 1))],
        "date string, province string, adid bigint, clickCount bigint")
    assert rows(ads.province_top(counts)) == [(d, "p", a, n) for d in ("d1", "d2") for a, n in
                                              ((1, 1), (2, 5), (3, 5))]


def test_sliding_hour_by_brute_force(spark):
    minutes = [0, 0, 3, 59, 60, 61, 200, 261]
    items = [(f"2024-01-01 {m // 60:02d}:{m % 60:02d}:17", "p", "c", 1, m % 2) for m in minutes]
    want = {}
    for m in minutes:
        for start in range(m - 59, m + 1):
            want[start, m % 2] = want.get((start, m % 2), 0) + 1
    import datetime
    base = datetime.datetime(2024, 1, 1)

    def text(m):
        return (base + datetime.timedelta(minutes=m)).strftime("%Y%m%d%H%M")

    expected = sorted((text(s), text(s + 60), a, n) for (s, a), n in want.items())
    assert rows(ads.hour_sliding(clicks_of(spark, items))) == expected


def test_minute_trend(spark):
    clicks = clicks_of(spark, [("2024-01-01 09:05:59", "p", "c", 1, 7), ("2024-01-01 09:05:00", "p", "c", 2, 7)])
    assert rows(ads.minute_trend(clicks)) == [("20240101", "09", "05", 7, 2)]
