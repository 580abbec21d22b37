"""Physical plans: what must not be in them at any size of the tables."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from wavebook.operators import joins, predicates
from wavebook.plans import standins, survey_queries, view_queries
from wavebook.sources.tables import table

QUERIES = {**survey_queries.registry.queries, **view_queries.registry.queries}
FOLDER = "/root/testdata/sf0.001"
# A window over the sizes of sort slices, one row per task, may be in one partition.
SLICE_WINDOWS = {"numbered_rows", "row_ids_passing", "page_far_down"}


def plan(frame) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        frame.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_python_or_lone_windows(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", text)
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups", text)
    if name not in SLICE_WINDOWS:
        assert not re.search(r"Window[^\n]*\n(?:[^\n]*\n){0,3}[^\n]*SinglePartition", text)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["model_sample"](spark, FOLDER))
    assert "EqualTo(l_returnflag,N)" in text and "LessThanOrEqual(l_discount,0.05)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double,l_discount:double,l_returnflag:string>" in text


def test_block_of_rows_is_a_pushed_filter(spark):
    text = plan(QUERIES["row_block"](spark, FOLDER))
    assert "GreaterThanOrEqual(c_acctbal" in text and "Exchange" not in text


def test_first_per_key_is_limited_before_the_shuffle(spark):
    text = plan(QUERIES["distinct_keep_first"](spark, FOLDER))
    assert text.index("WindowGroupLimit") < text.index("Exchange") or "Partial" in text
    assert len(re.findall(r"^\(\d+\) WindowGroupLimit", text, re.M)) == 2


def test_one_scan_for_all_domains(spark):
    text = plan(QUERIES["filter_domains"](spark, FOLDER))
    assert len(re.findall(r"^\(\d+\) Scan parquet", text, re.M)) == 2  # one for each of its two tables


@pytest.mark.parametrize("name", ["period_mean_ratio", "nearest_year_indicators", "trust_inequality", "income_shares"])
def test_years_reach_the_scan_of_the_largest_table(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    pushed = [line for line in text.splitlines() if "PushedFilters" in line and "l_shipdate" in line]
    assert pushed and all("LessThan(l_shipdate" in line for line in pushed)


def test_a_range_of_whole_numbers_reaches_the_scan(spark):
    orders = table(spark, FOLDER, "orders")
    text = plan(orders.where(predicates.in_range(F.col("o_orderkey"), 5, 9)))
    assert "GreaterThanOrEqual(o_orderkey,5)" in text and "LessThanOrEqual(o_orderkey,9)" in text


def test_orders_are_exchanged_once_to_be_counted(spark, monkeypatch):
    """Too many customers to broadcast: one shuffle of the orders, then one of the counts."""
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(standins.answer_counts(spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = re.findall(r"hashpartitioning\((.*?), \d+\)", text)
    orders = [e for e in exchanges if e.startswith("o_custkey")]
    assert len(orders) == 1 and len(exchanges) <= 5
    assert not any("wave" in e and "custkey" in e for e in exchanges)
