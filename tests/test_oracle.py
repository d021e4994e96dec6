"""Every named query against DuckDB on the same tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as spark_entry
from clickweave import catalog, oracle
from clickweave.sources import testdata
from tests.compare import connect, duck_bag, spark_bag

QUERIES = spark_entry.queries()
ORACLES = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(oracle_dir):
    return connect(oracle_dir)


def test_every_query_has_an_oracle():
    assert set(catalog.all_queries()) == set(oracle.all_oracles())
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(oracle.all_oracles()))
def test_query_agrees_with_sql(spark, duck, oracle_dir, name):
    got, want = spark_bag(QUERIES[name](spark, oracle_dir)), duck_bag(duck, ORACLES[name])
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert want[1]


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 15


def rows(spark, oracle_dir, name):
    return QUERIES[name](spark, oracle_dir).collect()


def test_inputs_can_tell_right_from_wrong(spark, oracle_dir):
    """Filters drop rows at both ends, joins lose rows, groups hold several members, top lists leave rows out."""
    actions = testdata.user_visit_action(spark, oracle_dir).collect()
    for name in ("action_scan", "action_scan_by_time"):
        kept = {r.event_id for r in rows(spark, oracle_dir, name)}
        dropped = {r.date for r in actions if r.event_id not in kept}
        assert min(dropped) < "2024-01-05" and max(dropped) > "2024-01-20" and len(kept) > 1000
    clicks = rows(spark, oracle_dir, "area_click_scan")
    assert len(rows(spark, oracle_dir, "area_click_base")) < len(clicks)
    grouped, known = rows(spark, oracle_dir, "area_product_clicks"), rows(spark, oracle_dir, "area_product_info")
    assert len(known) < len(grouped) and sum("," in r.city_info for r in grouped) > 20
    assert len(rows(spark, oracle_dir, "session_profile")) < len(rows(spark, oracle_dir, "session_rollup"))
    assert len(rows(spark, oracle_dir, "ad_province_daily")) < len(rows(spark, oracle_dir, "ad_city_daily"))
    assert len(rows(spark, oracle_dir, "ad_province_top3")) < len(rows(spark, oracle_dir, "ad_province_daily"))
    assert 0 < len(rows(spark, oracle_dir, "ad_blacklist")) < 50
    assert len(rows(spark, oracle_dir, "session_sample")) == 100
    kept = rows(spark, oracle_dir, "session_buckets")[0].session_count
    assert len(rows(spark, oracle_dir, "session_sample_1000")) == min(1000, kept)
    assert len({r.unreadable for r in rows(spark, oracle_dir, "action_rejects")}) == 3
