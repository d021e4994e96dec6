from __future__ import annotations

import pytest

from clickweave import sinks
from clickweave.streaming import tables as stream_tables
from clickweave.streaming.tables import GroupTable, KeySet, StreamTable


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_append_parquet(spark, tmp_path):
    path = str(tmp_path / "t")
    for task in ("a", "b"):
        sinks.append_parquet(spark.createDataFrame([(task, 1)], "taskid string, n int"), path, ("taskid",))
    assert rows(spark.read.parquet(path).select("taskid", "n")) == [("a", 1), ("b", 1)]


def test_replace_table(spark):
    for value in (1, 2):
        sinks.replace_table(spark.createDataFrame([(value,)], "n int"), "replaced")
    assert rows(spark.table("replaced")) == [(2,)]
    spark.sql("DROP TABLE replaced")


def fill(spark, table, batches, schema):
    for i, batch in enumerate(batches):
        table.write(spark.createDataFrame(batch, schema), i)


def test_added_and_latest(spark, tmp_path):
    schema = "date string, k bigint, n bigint"
    batches = [[("d1", 1, 5), ("d1", 2, 1)], [("d1", 1, 2)], [], [("d2", 1, 7), ("d1", 2, 4)], [("d1", 3, 1)]]
    added = StreamTable(str(tmp_path / "a"), schema, "added", ("date", "k"), "date")
    latest = StreamTable(str(tmp_path / "l"), schema, "latest", ("date", "k"), "date")
    fill(spark, added, batches, schema)
    fill(spark, latest, batches, schema)
    columns = ["date", "k", "n"]
    assert rows(added.read(spark, 5).select(*columns)) == [("d1", 1, 7), ("d1", 2, 5), ("d1", 3, 1), ("d2", 1, 7)]
    assert rows(latest.read(spark, 5).select(*columns)) == [("d1", 1, 2), ("d1", 2, 4), ("d1", 3, 1), ("d2", 1, 7)]
    assert rows(added.read(spark, 5, ["d2"]).select(*columns)) == [("d2", 1, 7)]
    assert rows(added.read(spark, 4, ["d1", "d9"]).select(*columns)) == [("d1", 1, 7), ("d1", 2, 5)]
    assert rows(added.changed(spark, 4, added._places(spark, ["d1"])).select(*columns)) == [("d1", 3, 1)]
    assert rows(added.read(spark, 0)) == []


def files_below(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_few_keys_cost_few_buckets(spark, tmp_path, monkeypatch):
    """Ten keys into a date of a million: at most ten buckets are read and written, and a replay changes nothing."""
    from pyspark.sql import functions as F
    schema = "date string, k bigint, n bigint"
    table = StreamTable(str(tmp_path / "t"), schema, "added", ("date", "k"), "date", buckets=64)
    table.write(spark.range(1_000_000).select(F.lit("d1").alias("date"), F.col("id").alias("k"), F.lit(1).cast("long").alias("n")), 0)
    before = files_below(tmp_path / "t")
    assert len({name.split("/")[1] for name in before}) == 64
    read = []
    load = StreamTable._load
    monkeypatch.setattr(StreamTable, "_load", lambda self, s, b, places, **o: read.extend(load(self, s, b, places, **o).inputFiles()) or load(self, s, b, places, **o))
    few = spark.createDataFrame([("d1", 100_003 * i, 5) for i in range(9)] + [("d1", -1, 5)], schema)
    places = table.write(few, 1)
    assert len(places) <= 10 and len({name.split("bucket=")[1].split("/")[0] for name in read}) <= 10
    written = files_below(tmp_path / "t")
    assert len(written.keys() - before.keys()) <= 10 and {name: written[name] for name in before} == before
    once = rows(table.changed(spark, 1, places).select("k", "n"))
    assert once == sorted([(100_003 * i, 6) for i in range(9)] + [(-1, 5)])
    table.write(few, 1)
    assert rows(table.changed(spark, 1, places).select("k", "n")) == once
    assert table.read(spark, 2).agg(F.count("*"), F.sum("n")).first()[:] == (1_000_001, 1_000_050)


def test_groups_are_replaced_by_folder(spark, tmp_path):
    schema = "date string, province string, ad bigint, n bigint"
    table = GroupTable(str(tmp_path / "g"), schema, ("date", "province"))
    assert rows(table.read(spark)) == []
    table.write(spark.createDataFrame([("d1", "p", 1, 3), ("d1", "p", 2, 2), ("d1", "q", 1, 1), ("d1", "", 8, 8), ("d1", "a/b=c", 1, 1)], schema))
    before = files_below(tmp_path / "g")
    again = spark.createDataFrame([("d1", "p", 3, 9), ("d2", "p", 1, 1)], schema)
    for _ in range(2):  # a replay changes nothing
        table.write(again)
        assert rows(table.read(spark)) == [("d1", "", 8, 8), ("d1", "a/b=c", 1, 1), ("d1", "p", 3, 9), ("d1", "q", 1, 1), ("d2", "p", 1, 1)]
    after = files_below(tmp_path / "g")
    kept = {name for name in before if "of_province==p" not in name and "of_province=%3Dp" not in name}
    assert len(kept) == 3 and all(after[name] == before[name] for name in kept)


def test_key_set(spark, tmp_path, monkeypatch):
    schema = "userid bigint"
    listed = KeySet(str(tmp_path / "b"), "userid")
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], schema)
    assert rows(listed.add(frame([1, 1, -5, 2**62]), 0)) == [(-5,), (1,), (2**62,)]
    before = files_below(tmp_path / "b")
    for batch in (1, 2):
        assert rows(listed.add(frame([1, -5]), batch)) == []
    assert rows(listed.add(frame([]), 3)) == [] and files_below(tmp_path / "b") == before
    for _ in range(2):  # a replay finds the same new keys
        assert rows(listed.add(frame([1, 7]), 4)) == [(7,)]
    assert rows(listed.read(spark, 4)) == [(-5,), (1,), (2**62,)] and rows(listed.read(spark, 5)) == [(-5,), (1,), (7,), (2**62,)]
    monkeypatch.setattr(stream_tables, "MOST_FOLDERS", 3)
    for batch in range(5, 14):
        listed.add(frame([batch * 10, 1]), batch)
    want = sorted([(-5,), (1,), (7,), (2**62,)] + [(batch * 10,) for batch in range(5, 14)])
    assert rows(listed.read(spark, 14)) == want
    assert len(list((tmp_path / "b" / "keys").iterdir())) <= 4 and len(list((tmp_path / "b" / "bitmap").iterdir())) == 2


def test_only_marked_rows_are_looked_up(spark, tmp_path):
    listed = KeySet(str(tmp_path / "b"), "userid")
    ids = list(range(0, 4000, 40))
    listed.add(spark.createDataFrame([(i,) for i in ids], "userid bigint"), 0)
    clicks = spark.range(4000).selectExpr("id AS userid", "id % 3 AS adid")
    marked = listed.suspects(clicks, 1)
    suspects = {r.userid for r in marked.where("suspect").collect()}
    assert set(ids) <= suspects and len(suspects) < len(ids) + 20 and marked.count() == 4000
    seen = []

    def anti_join(rows_, known):
        seen.append(rows_)
        return rows_.join(known, "userid", "left_anti")

    assert rows(listed.without(clicks, 1, anti_join).select("userid")) == [(i,) for i in range(4000) if i % 40]
    assert {r.userid for r in seen[0].collect()} == suspects
    assert listed.without(clicks, 0).count() == 4000
    pieces = listed.bitmap(spark, 1).collect()
    assert len(pieces) <= 256 and all(len(p.bits) == 4096 for p in pieces)


def test_unknown_merge_rule(spark, tmp_path):
    with pytest.raises(ValueError):
        StreamTable(str(tmp_path), "k bigint", "sum", ("k",))
