"""Every query against its SQL on the stand-in tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences
from wavebook.operators import joins
from wavebook.plans import standins, survey_queries, view_queries
from wavebook.sources.tables import SCHEMAS

FOLDERS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]
QUERIES = {**survey_queries.registry.queries, **view_queries.registry.queries}
SQL = {**survey_queries.registry.sql, **view_queries.registry.sql}


@pytest.fixture(scope="module")
def databases():
    return {folder: connect(folder) for folder in FOLDERS}


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("folder", FOLDERS)
def test_same_as_sql(spark, databases, folder, name):
    assert differences(QUERIES[name](spark, folder), databases[folder], SQL[name]) == []


HOT = {
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey) FROM t",
    "lineitem": "SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 3 ELSE l_suppkey END AS l_suppkey) FROM t",
    "customer": """SELECT * REPLACE (CASE WHEN c_custkey % 3 = 0 THEN 7 ELSE c_nationkey END AS c_nationkey,
                                     CASE WHEN c_custkey % 3 = 1 THEN 100.0 ELSE c_acctbal END AS c_acctbal)
                   FROM t""",
    "part": "SELECT * FROM t UNION ALL SELECT t.* FROM t, range(150) WHERE p_partkey = 3",
}


@pytest.fixture(scope="module")
def hot_folder(tmp_path_factory):
    """A third of all orders, line items, customers or parts share one key, value or copy."""
    folder = tmp_path_factory.mktemp("hot")
    con = duckdb.connect()
    for name in SCHEMAS:
        query = HOT.get(name, "SELECT * FROM t").replace("FROM t", f"FROM '{FOLDERS[0]}/{name}.parquet' t")
        con.execute(f"COPY ({query}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def hot_database(hot_folder):
    return connect(hot_folder)


@pytest.fixture
def shuffled_joins(spark):
    """No join is broadcast by size and adaptive partitions are tiny, as with large tables."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql_with_hot_keys(spark, shuffled_joins, hot_folder, hot_database, name):
    sql = SQL[name]
    assert differences(QUERIES[name](spark, hot_folder), hot_database, sql) == []


def test_same_as_sql_with_salted_joins(spark, shuffled_joins, hot_folder, hot_database, monkeypatch):
    """Customers count as too many to broadcast, and one of them has a third of the orders."""
    monkeypatch.setattr(joins.sized_join, "__defaults__", ("left", True, True, 0, 4))
    answers = standins.answers(spark, hot_folder)
    assert "_salt" in answers._jdf.queryExecution().optimizedPlan().toString()
    for name in ("trust_window", "country_file_scan", "split_export_manifest"):
        assert differences(QUERIES[name](spark, hot_folder), hot_database, SQL[name]) == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_queries_without_sql_give_rows(spark):
    assert sorted(set(QUERIES) - set(SQL)) == []


def test_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_queries_give_rows_to_compare(databases):
    empty = [n for n in SQL if not databases[FOLDERS[1]].execute(SQL[n]).fetchone()]
    assert empty == []
