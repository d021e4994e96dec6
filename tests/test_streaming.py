"""The streams against their batch forms, on the same lines cut into files."""

from __future__ import annotations

import os

import pytest

from clickweave import schemas
from clickweave.operators import words
from clickweave.plans import shared
from clickweave.sources import ad_lines, testdata
from clickweave.streaming import ad_stream
from clickweave.streaming.tables import StreamTable
from clickweave.streaming.words import running_word_count

THRESHOLD = 7
FILES = 4


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def lines(spark, small_dir):
    ordered = testdata.ad_line(spark, small_dir).orderBy("ts").collect()
    values = [r["value"] for r in ordered]
    size = -(-len(values) // FILES)
    return [values[i:i + size] for i in range(0, len(values), size)]


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def write_files(folder, chunks, first=0):
    folder.mkdir(exist_ok=True)
    for i, chunk in enumerate(chunks, first):
        path = folder / f"part-{i:03d}.txt"
        path.write_text("\n".join(chunk) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))   # the file source goes by these times
    return str(folder)


def expected(chunks, threshold):
    """Plain replay of the batch rule."""
    import collections
    import datetime
    listed, users, cities, trend = set(), collections.Counter(), collections.Counter(), collections.Counter()
    for chunk in chunks:
        touched = set()
        dropped = set(listed)
        for line in chunk:
            ms, province, city, user, ad = line.split(" ")
            if int(user) in dropped:
                continue
            at = datetime.datetime.fromtimestamp(int(ms) / 1000, datetime.timezone.utc)
            key = (at.strftime("%Y-%m-%d"), int(user), int(ad))
            users[key] += 1
            touched.add(key)
            cities[(key[0], province, city, int(ad))] += 1
            trend[(at.strftime("%Y%m%d"), at.strftime("%H"), at.strftime("%M"), int(ad))] += 1
        listed |= {key[1] for key in touched if users[key] >= threshold}

    def flat(counter):
        return sorted((*key, n) for key, n in counter.items())

    return flat(users), sorted((u,) for u in listed), flat(cities), flat(trend)


def top_three(city_rows):
    groups = {}
    for date, province, _, ad, n in city_rows:
        groups.setdefault((date, province), {}).setdefault(ad, 0)
        groups[(date, province)][ad] += n
    return sorted((d, p, ad, n) for (d, p), ads_ in groups.items()
                  for ad, n in sorted(ads_.items(), key=lambda x: (-x[1], x[0]))[:3])


def check_tables(spark, tables, chunks, threshold=THRESHOLD):
    users, listed, cities, trend = expected(chunks, threshold)
    before = len(chunks)
    assert rows(tables.user_counts.read(spark, before).select("date", "userid", "adid", "clickCount")) == users
    assert rows(tables.blacklist.read(spark, before)) == listed
    assert rows(tables.city_counts.read(spark, before)
                .select("date", "province", "city", "adid", "clickCount")) == cities
    assert rows(tables.trend.read(spark, before).select("date", "hour", "minute", "adid", "clickCount")) == trend
    assert rows(tables.province_top.read(spark)
                .select("date", "province", "adid", "clickCount")) == top_three(cities)


def busy(chunks):
    """Lines of few users on two days, so that the threshold is reached in the first batches."""
    day = 86_400_000

    def fold(line):
        parts = line.split(" ")
        ms = int(parts[0])
        parts[0] = str(ms - ms % (32 * day) + ms // day % 2 * day + ms % 3_600_000)
        parts[3] = str(int(parts[3]) % 6)
        return " ".join(parts)
    return [[fold(line) for line in chunk] for chunk in chunks]


def run_ads(spark, source, tables, checkpoint, **kwargs):
    query = ad_stream.start_ad_stream(
        ad_lines.file_lines(spark, source, 1), tables, checkpoint, THRESHOLD, available_now=True, **kwargs)
    query.awaitTermination(300)
    assert query.exception() is None


def test_blacklist_feedback_over_two_runs(spark, lines, tmp_path):
    chunks = busy(lines)
    source, check = tmp_path / "in", str(tmp_path / "check")
    tables = ad_stream.AdTables.under(str(tmp_path / "out"))
    run_ads(spark, write_files(source, chunks[:2]), tables, check)
    check_tables(spark, tables, chunks[:2])
    run_ads(spark, write_files(source, chunks[2:], 2), tables, check)
    check_tables(spark, tables, chunks)
    users, listed, _, _ = expected(chunks, THRESHOLD)
    assert listed and sum(r[-1] for r in users) < sum(map(len, chunks))


def test_replayed_batch_changes_nothing(spark, lines, tmp_path):
    chunks = busy(lines)
    tables = ad_stream.AdTables.under(str(tmp_path / "out"))
    for i in (0, 1, 1, 2, 2):
        batch = spark.createDataFrame([(v,) for v in chunks[i]], "value string")
        ad_stream.process_batch(batch, i, tables, THRESHOLD, probe_skew=True)
    check_tables(spark, tables, chunks[:3])


def test_published_rows_rebuild_the_tables(spark, lines, tmp_path):
    chunks = busy(lines)[:2]
    tables = ad_stream.AdTables.under(str(tmp_path / "out"))
    database = {}

    def upsert(name, changed):
        keys = dict(tables.keys())[name]
        target = database.setdefault(name, {})
        groups = {}
        for row in changed.collect():
            groups.setdefault(tuple(row[k] for k in keys), []).append(tuple(row[c] for c in sorted(row.asDict())))
        target.update(groups)

    for i, chunk in enumerate(chunks):
        batch = spark.createDataFrame([(v,) for v in chunk], "value string")
        ad_stream.process_batch(batch, i, tables, THRESHOLD, publish=upsert)
    stored = {"ad_province_top3": tables.province_top.read(spark)}
    for table in (tables.user_counts, tables.blacklist, tables.city_counts, tables.trend):
        stored[table.path.split("/")[-1]] = table.read(spark, len(chunks))
    assert stored.keys() == dict(tables.keys()).keys()
    for name, current in stored.items():
        published = sorted(row for group in database[name].values() for row in group)
        assert published == rows(current.select(*sorted(current.columns))) and published


def test_unreadable_lines_go_to_rejects(spark, tmp_path):
    tables = ad_stream.AdTables.under(str(tmp_path / "out"))
    bad = ["", "abc 1 1 2 3", "1704067200000 1 1 2", "1704067200000 1 1 x 3"]
    batch = spark.createDataFrame([(v,) for v in [*bad, "1704067200000 1 1 2 3"]], "value string")
    ad_stream.process_batch(batch, 0, tables)
    assert rows(spark.read.text(f"{tables.rejects}/batch_id=0")) == sorted((v,) for v in bad)
    assert rows(tables.user_counts.read(spark, 1).select("date", "userid", "adid", "clickCount")) == [
        ("2024-01-01", 2, 3, 1)]


def test_empty_batch(spark, tmp_path):
    tables = ad_stream.AdTables.under(str(tmp_path / "out"))
    ad_stream.process_batch(spark.createDataFrame([], "value string"), 0, tables)
    assert tables.city_counts.read(spark, 1).count() == 0
    assert tables.blacklist.read(spark, 1).count() == 0


def test_only_touched_dates_are_read(spark, tmp_path, monkeypatch):
    """A batch reads no other date, a bad clock adds its own date only, an empty batch reads and writes nothing."""
    tables = ad_stream.AdTables.under(str(tmp_path / "out"))
    day = 86_400_000
    start = 1_704_067_200_000

    def batch(batch_id, *millis):
        lines = spark.createDataFrame([(f"{ms} 1 1 2 3",) for ms in millis], "value string")
        ad_stream.process_batch(lines, batch_id, tables)

    for i in range(3):
        batch(i, start + i * day)
    read = []
    states = StreamTable._states
    monkeypatch.setattr(StreamTable, "_states", lambda self, spark, place: read.append(place[0]) or states(self, spark, place))
    batch(3, start + day, 0)
    assert set(read) - {"all"} == {"2024-01-02", "1970-01-01", "20240102", "19700101"}
    read.clear()
    batch(4)
    assert set(read) <= {"all"}
    assert rows(tables.user_counts.read(spark, 5).select("date", "clickCount")) == [
        ("1970-01-01", 1), ("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 1)]


def test_files_of_a_date_do_not_grow_with_the_batches(spark, tmp_path):
    table = StreamTable(str(tmp_path / "t"), schemas.AD_CLICK_TREND, "added", ("date", "hour", "minute", "adid"), "date")
    row = spark.createDataFrame([("20240101", "01", "02", 7, 1)], schemas.AD_CLICK_TREND)
    for batch_id in (0, 1, 2, 250, 251, 999, 999):
        table.write(row, batch_id)
    assert rows(table.read(spark, 1000).select("clickCount")) == [(6,)]
    assert rows(table.read(spark, 999).select("clickCount")) == [(5,)]
    assert sorted(p.name for p in (tmp_path / "t" / "date=20240101").glob("bucket=*/*")) == ["state=251", "state=999"]
    assert len(list((tmp_path / "t").rglob("*.parquet"))) <= 2 * 3


def test_steps_of_a_batch_stay_in_the_job_group(spark, lines, tmp_path, monkeypatch):
    groups = []
    rejects = ad_stream.ad_rejects
    monkeypatch.setattr(ad_stream, "ad_rejects", lambda x: groups.append(spark.sparkContext.getLocalProperty("spark.jobGroup.id")) or rejects(x))
    run_ads(spark, write_files(tmp_path / "in", lines[:1]), ad_stream.AdTables.under(str(tmp_path / "out")), str(tmp_path / "check"))
    assert groups and all(groups)


def test_report_of_the_ad_stream(spark, lines, tmp_path):
    """Counts add up over batches, runs and replays."""
    chunks = busy(lines)
    chunks[1] = [*chunks[1], "not a click", f"{2_000_000_000_000} 1 1 5000 1"]
    tables = ad_stream.AdTables.under(str(tmp_path / "out"))
    for i in (0, 1, 1, 2, 2, 3):
        ad_stream.process_batch(spark.createDataFrame([(v,) for v in chunks[i]], "value string"), i, tables, THRESHOLD)
    ad_stream.process_batch(spark.createDataFrame([], "value string"), 4, tables, THRESHOLD)
    got = dict(rows(tables.report.read(spark, 5)))
    users, *_ = expected([[v for v in chunk if v != "not a click"] for chunk in chunks], THRESHOLD)
    accepted = sum(r[-1] for r in users)
    assert got["read"] == sum(map(len, chunks)) and got["rejected"] == 1
    assert got["accepted"] == accepted and got["blacklisted"] == got["read"] - 1 - accepted
    assert 0 < got["late"] < accepted


def test_running_word_count(spark, tmp_path):
    chunks = [["a b  a", ""], ["b c", " a "]]
    source, check = tmp_path / "in", str(tmp_path / "check")
    for i, chunk in enumerate(chunks):
        write_files(source, [chunk], i)
        query = (
            running_word_count(spark.readStream.text(str(source))).writeStream.outputMode("complete")
            .format("memory").queryName("running_words").option("checkpointLocation", check)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination(300)
        assert query.exception() is None
    assert rows(spark.table("running_words")) == [("a", 3), ("b", 2), ("c", 1)]
    assert rows(words.word_count(spark.read.text(str(source)))) == [("a", 3), ("b", 2), ("c", 1)]


def test_checkpoint_folder_is_required(spark, monkeypatch):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared.shared_folder(spark, None, "x") == f"{folder}/x"
    assert shared.shared_folder(spark, "given", "x") == "given"
    monkeypatch.setattr(shared, "CHECKPOINT_SETTING", "spark.no.such.setting")
    with pytest.raises(ValueError):
        shared.shared_folder(spark, None, "x")
