"""Stream operators with state of their own against batch forms and plain recounts."""

from __future__ import annotations

import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from clickweave import schemas
from clickweave.operators import ads
from clickweave.sources import ad_lines, testdata
from clickweave.streaming import ad_stream, state
from clickweave.streaming.tables import StreamTable
from tests.test_streaming import busy, rows, write_files

CLICK = "ts timestamp, province string, city string, userid bigint, adid bigint, event_id bigint"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def shuffled(spark, small_dir):
    """All lines in no order: a click may come years after newer ones."""
    values = [r["value"] for r in testdata.ad_line(spark, small_dir).collect()]
    random.Random(3).shuffle(values)
    size = -(-len(values) // 4)
    return [values[i:i + size] for i in range(0, len(values), size)]


def done(query):
    assert query.awaitTermination(100)
    assert query.exception() is None
    return query


@pytest.mark.parametrize("kind", ["city", "trend"])
def test_no_late_click_is_lost_and_a_restart_goes_on(spark, shuffled, tmp_path, kind):
    source = tmp_path / "in"
    if kind == "city":
        form, batch_form = state.city_daily_counts, ads.city_daily
        table = StreamTable(str(tmp_path / "t"), schemas.AD_STAT, "latest", ("date", "province", "city", "adid"), "date")
    else:
        form, batch_form = state.minute_trend_counts, ads.minute_trend
        table = StreamTable(str(tmp_path / "t"), schemas.AD_CLICK_TREND, "latest", ("date", "hour", "minute", "adid"), "date")
    for first, last in ((0, 2), (2, 4)):  # a second query on the same checkpoint
        path = write_files(source, shuffled[first:last], first)
        clicks = ad_lines.ad_parse(ad_lines.file_lines(spark, path, 1))
        query = done(ad_stream.upsert_stream(form(clicks), table, str(tmp_path / "check"), available_now=True))
        want = batch_form(ad_lines.ad_parse(spark.read.text(path)))
        assert rows(table.read(spark, query.lastProgress["batchId"] + 1).select(*want.columns)) == rows(want)


def test_counts_move_once_per_batch_of_rows(spark):
    clicks = spark.range(50_000).select((F.col("id") % 2).alias("adid"))
    found = state.counted(clicks, ["adid"])
    assert found.count() < 100 and rows(found.groupBy("adid").agg(F.sum("n"))) == [(0, 25_000), (1, 25_000)]


# ---- the last hour by arrival ----

def test_ring_equals_recount_under_a_controlled_clock():
    rng = random.Random(5)
    ring, arrived, now = state.Ring.empty(100, 60), deque(), 100
    for _ in range(3000):
        now += rng.choice([0, 0, 1, 1, 2, 7, 59, 60, 61, 200])
        ring.advance(now)
        n = rng.randrange(5)
        ring.add(n)
        arrived.append((now, n))
        while arrived[0][0] <= now - 60:
            arrived.popleft()
        assert ring.total == sum(n for _, n in arrived) and len(ring.counts) == 60
        assert sum(ring.counts) == ring.total
    ring.advance(now - 5)
    assert ring.slot == now


class FileClock:
    """A clock that a test sets; workers read it from a file."""

    def __init__(self, path):
        self.path = str(path)

    def set(self, minute):
        with open(self.path, "w") as file:
            file.write(str(minute * state.SLOT_MS + 12_345))

    def __call__(self, _timer_values):
        with open(self.path) as file:
            return int(file.read())


def test_rolling_hour_by_arrival(spark, tmp_path):
    """Batches at set minutes, some of them hours after the click: every report equals a recount of what arrived in the hour."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # the timers of the set clock are always due
    clock, got = FileClock(tmp_path / "clock"), []
    arrivals = [(500, [7, 7, 8]), (500, [7]), (530, [8]), (559, [7, 7]), (560, [9]), (589, [9]), (590, [7]), (700, [8])]
    source = tmp_path / "in"

    def keep(batch, _batch_id):
        got.extend((r.window_end_ms // state.SLOT_MS - 1, r.adid, r.clickCount) for r in batch.collect())

    seen, reported = [], 0
    for i, (minute, adids) in enumerate(arrivals):
        clock.set(minute)
        write_files(source, [[f"{1_700_000_000_000 + 86_400_000 * (7 - i)} 1 1 5 {ad}" for ad in adids]], i)
        clicks = ad_lines.ad_parse(ad_lines.file_lines(spark, str(source)))
        done(state.rolling_counts(clicks, clock=clock).writeStream.outputMode("update").foreachBatch(keep).option(
            "checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
        seen += [(minute, ad) for ad in adids]
        recount = Counter(ad for at, ad in seen if at > minute - 60)
        fresh, reported = got[reported:], len(got)
        assert {ad for _, ad, _ in fresh} >= set(adids)
        latest = {}
        for at, ad, n in fresh:
            assert at == minute and n == recount[ad]
            latest[ad] = n
    assert (700, 8, 1) in got
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_timers_empty_the_ring(spark, tmp_path):
    """With slots of a second and no more clicks, reports go on by themselves until the window is empty."""
    got = []
    source = write_files(tmp_path / "in", [[f"{i} 1 1 5 {i % 2}" for i in range(9)]])
    clicks = ad_lines.ad_parse(ad_lines.file_lines(spark, source))

    def keep(batch, _batch_id):
        got.extend((r.adid, r.window_end_ms, r.clickCount) for r in batch.collect())

    query = state.rolling_counts(clicks, slot_ms=1000, slots=3).writeStream.outputMode("update").foreachBatch(keep).option(
        "checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    for _ in range(60):
        if {ad for ad, _, n in got if n == 0} == {0, 1} or query.awaitTermination(1):
            break
    query.stop()
    for ad, n in ((0, 5), (1, 4)):
        own = sorted((at, found) for key, at, found in got if key == ad)
        assert own[0][1] == n and own[-1][1] == 0 and {found for _, found in own} == {n, 0}


# ---- the blacklist, click by click ----

@pytest.mark.parametrize("per_file", [40, 333, 100_000])
def test_feedback_click_by_click_equals_batch(spark, small_dir, tmp_path, per_file):
    threshold = 7
    lines = [r["value"] for r in testdata.ad_line(spark, small_dir).orderBy("ts").collect()]
    lines = busy([lines])[0]
    ordered = sorted(lines, key=lambda line: int(line.split(" ")[0]))[:900]
    numbered = [f"{line} {i}" for i, line in enumerate(ordered)]
    source = write_files(tmp_path / "in", [numbered[i:i + per_file] for i in range(0, len(numbered), per_file)])

    def parse(text):
        part = F.split("value", " ")
        return text.select(F.timestamp_millis(part[0].cast("long")).alias("ts"), part[1].alias("province"), part[2].alias("city"),
                           part[3].cast("long").alias("userid"), part[4].cast("long").alias("adid"), part[5].cast("long").alias("event_id"))

    want = ads.accepted_clicks(parse(spark.read.text(source)), threshold)
    stream = parse(spark.readStream.option("maxFilesPerTrigger", 8).text(source))
    name = f"accepted_{per_file}"
    done(state.accepted_stream(stream, threshold).writeStream.outputMode("append").format("memory").queryName(name).option(
        "checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    assert rows(spark.table(name).select(*want.columns)) == rows(want)
    assert 0 < want.count() < 900


def test_counts_of_old_days_expire(spark, tmp_path):
    """Six clicks of a day, then a day far later, then the seventh of the old day: the old count is gone."""
    day = 86_400_000
    chunks = [[f"{i} 1 1 5 3 {i}" for i in range(6)], [f"{30 * day} 1 1 5 3 10"], [f"{7} 1 1 5 3 11"], [f"{8} 1 1 5 3 12"]]
    source = write_files(tmp_path / "in", chunks)
    part = F.split("value", " ")
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(source).select(
        F.timestamp_millis(part[0].cast("long")).alias("ts"), part[3].cast("long").alias("userid"), part[4].cast("long").alias("adid"),
        part[5].cast("long").alias("event_id"))
    done(state.accepted_stream(stream, 7, kept_days=7).writeStream.outputMode("append").format("memory").queryName("expired").option(
        "checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    assert spark.table("expired").count() == 9
