"""All registered queries against their SQL on the smallest test tables, and plan checks."""

import os

import pytest

import __spark_entry__ as registered
from fencewatch.workload.oracles import ORACLES
from fencewatch.workload.queries import QUERIES
from tests.oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not there")


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, connection, name):
    assert compare(spark, connection, name, SMALL) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("zone", ["America/Vancouver", "Asia/Tokyo"])
@pytest.mark.parametrize("name", ["posted_after", "delay_gap", "summary_rows", "html_search_after"])
def test_days_do_not_depend_on_the_session_zone(spark, connection, name, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert compare(spark, connection, name, SMALL) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_entry(spark):
    assert registered.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_stay_in_the_jvm_and_pair_nothing_with_everything(spark, name):
    frame = registered.queries()[name](spark, SMALL)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_city_filter_reaches_the_scan(spark):
    frame = registered.queries()["city_filter"](spark, SMALL)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(url,http://blog.)" in plan
    assert "html" not in plan


def test_scans_read_only_the_columns_in_use(spark):
    frame = registered.queries()["phone"](spark, SMALL)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
