from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clickweave.functions import scalars as fn
from clickweave.functions.aggregates import count_between, group_concat_distinct
from clickweave.functions.sql_names import register_sql_functions
from clickweave.params import TaskParams


def values(spark, inputs, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def one(spark, inputs, column):
    return [r[0] for r in values(spark, inputs, column)]


def v():
    return F.col("v")


def test_packed_text_lookup(spark):
    rows = ["a=1|b=2", "b=2", "a=", "a=1=2", "aa=3|a=4", "a=|a=5", None, "x.a=9", "a=7="]
    assert one(spark, rows, fn.kv_get(v(), "a")) == ["1", None, None, None, "4", "5", None, None, "7"]
    assert one(spark, ["a=1,b=2"], fn.kv_get(v(), "b", ",")) == ["2"]


def test_packed_text_replacement(spark):
    rows = ["a=1|b=2", "b=2", "b=1|a=|c=3", "aa=3|a=4"]
    assert one(spark, rows, fn.kv_set(v(), "a", "$9")) == ["a=$9|b=2", "b=2", "b=1|a=$9|c=3", "aa=3|a=$9"]


def test_commas_padding_and_emptiness(spark):
    assert one(spark, [",a,", "a", "a,b,"], fn.trim_comma(v())) == ["a", "a", "a,b"]
    assert one(spark, ["1", "12", "123", ""], fn.pad2(v())) == ["01", "12", "123", "00"]
    assert one(spark, ["", None, "x"], fn.is_empty(v())) == [True, True, False]
    assert one(spark, ["", None, "x"], fn.is_not_empty(v())) == [False, False, True]
    assert one(spark, ["1,2,1"], fn.csv_values(v())) == [[1, 2]]
    assert one(spark, ["5, 5", "05,5", "x"], fn.csv_values(v())) == [[5], [5], [None]]


def test_times_with_and_without_padding(spark):
    at = fn.parse_action_time(v())
    rows = ["2018-06-25 6:27:16", "2018-06-25 16:27:16", "nonsense"]
    odd = ["12:30:00", "2018", "2018-06-25", "2018-06-25 6:27:16+05:00", "2018-06-25T06:27:16", "2018-13-25 6:27:16", None]
    assert one(spark, odd, at) == [None] * len(odd)
    assert one(spark, rows, fn.format_time(at)) == ["2018-06-25 06:27:16", "2018-06-25 16:27:16", None]
    assert one(spark, rows[:2], fn.date_hour(at)) == ["2018-06-25_06", "2018-06-25_16"]
    assert one(spark, rows[:1], fn.format_time_minute(at)) == ["201806250627"]
    assert one(spark, rows[:1], fn.format_date(at)) == ["2018-06-25"]
    assert one(spark, rows[:1], fn.format_date_key(at)) == ["20180625"]
    assert one(spark, ["20180625"], fn.parse_date_key(v()).cast("string")) == ["2018-06-25"]
    later = F.lit("2018-06-25 7:00:00")
    assert one(spark, rows[:2], fn.time_before(v(), later)) == [True, False]
    assert one(spark, rows[:2], fn.time_after(v(), later)) == [False, True]
    assert one(spark, rows[:1], fn.seconds_between(fn.parse_action_time(later), at)) == [1964]


def test_today_and_yesterday(spark):
    today, yesterday = spark.range(1).select(fn.today_date(), fn.yesterday_date()).first()
    assert (spark.range(1).select(F.datediff(F.lit(today), F.lit(yesterday))).first()[0]) == 1


def test_rounding_is_half_up_on_the_decimal_text(spark):
    assert one(spark, ["0.285", "0.125", "0.005"], fn.format_double(v().cast("double"))) == [0.29, 0.13, 0.01]


def test_names_and_json(spark):
    assert one(spark, ["x", None], fn.concat_id_name(F.lit(7), v())) == ["7:x", None]
    assert one(spark, ['{"product_status": 0}', "{}"], fn.json_field(v(), "product_status")) == ["0", None]


def test_sql_names(spark):
    register_sql_functions(spark)
    row = spark.sql("""
        SELECT concat_long_string(3, 'x', ':') a, get_json_value('{"product_status": 1}', 'product_status') b,
               listagg(DISTINCT v, ',') WITHIN GROUP (ORDER BY v) c
        FROM VALUES ('b'), ('a'), ('b') t(v)""").first()
    assert tuple(row) == ("3:x", "1", "a,b")


def test_distinct_concatenation_keeps_contained_values(spark):
    df = spark.createDataFrame([("g", "11:x"), ("g", "1:x"), ("g", "11:x"), ("h", None)], "g string, v string")
    got = {r["g"]: r["all"] for r in group_concat_distinct(df, ["g"], v(), "all").collect()}
    assert got == {"g": "11:x,1:x", "h": ""}


def test_bucket_bounds_are_inclusive(spark):
    df = spark.range(10)
    row = df.agg(count_between("id", 3, 5), count_between("id", 8, None)).first()
    assert tuple(row) == (3, 2)


@pytest.mark.parametrize("empty", [None, ""])
def test_parameters(empty):
    params = TaskParams.from_dict({
        "startDate": "2018-06-01", "endDate": "2018-06-30", "startAge": 20, "endAge": "50",
        "professionals": empty, "sex": empty, "keywords": "a, b", "categoryIds": "1,2", "targetPageFlow": "1,2,3"})
    assert params.professionals == () and params.sex is None and params.cities == ()
    assert params.keywords == ("a", "b") and params.category_ids == (1, 2)
    assert (params.start_age, params.end_age) == (20, 50) and params.target_page_flow == (1, 2, 3)
    assert TaskParams.from_json('{"startAge": ""}').start_age is None
