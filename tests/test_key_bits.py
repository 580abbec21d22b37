from functools import reduce

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from wavebook.operators import key_bits, linked

EDGES = [0, 1, 62, 63, 64, 65, -1, -63, -64, -65, 2**31, 2**62, 2**63 - 1, -(2**63)]
SETS = st.lists(st.lists(st.one_of(st.none(), st.sampled_from(EDGES), st.integers(-200, 200)), max_size=30), min_size=1, max_size=4)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def table_of(spark, keys, kind="bigint"):
    return spark.createDataFrame([(k,) for k in keys], f"key {kind}")


def keys_of(frame):
    return sorted(r.key for r in frame.collect())


@SETTINGS
@given(SETS)
def test_intersection_and_union(spark, lists):
    frames = [table_of(spark, keys) for keys in lists]
    held = [{k for k in keys if k is not None} for keys in lists]
    assert keys_of(key_bits.unpack(key_bits.intersect(frames))) == sorted(reduce(set.__and__, held))
    assert keys_of(key_bits.unpack(key_bits.union(frames))) == sorted(reduce(set.__or__, held))


@SETTINGS
@given(SETS)
def test_rows_kept(spark, lists):
    rows = [(k, i) for i, k in enumerate([*EDGES, None, *range(-70, 70), 0])]
    df = spark.createDataFrame(rows, "key bigint, bits int")
    got = linked.keep_linked(df, "key", {str(i): table_of(spark, keys) for i, keys in enumerate(lists)})
    held = reduce(set.__and__, [{k for k in keys if k is not None} for keys in lists])
    assert sorted(r.bits for r in got.collect()) == [i for k, i in rows if k in held]
    assert got.columns == ["key", "bits"]


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint", "string"])
def test_types_of_keys(spark, kind):
    texts = ["7", "9", "-3", "7"] if kind == "string" else [7, 9, -3, 7]
    rows = table_of(spark, texts, kind)
    filters = {"a": rows, "b": table_of(spark, texts[:1], kind), "c": None}
    got = linked.keep_linked(rows, "key", filters)
    assert [r.key for r in got.collect()] == texts[:1] * 2 and got.schema == rows.schema
    assert linked.intersect(filters).schema == rows.schema and keys_of(linked.intersect(filters)) == texts[:1]


def test_no_filter_and_an_empty_one(spark):
    rows = table_of(spark, [1, 2])
    assert linked.keep_linked(rows, "key", {"a": None}).count() == 2
    assert linked.keep_linked(rows, "key", {"a": None, "b": table_of(spark, [])}).count() == 0



def test_one_grouping_for_any_number_of_filters(spark):
    """Keys that repeat are merged with the others, not filter by filter."""
    raw = spark.range(1000).selectExpr("id % 200 AS key")
    for n in (2, 5):
        frame = linked.keep_linked(raw, "key", {str(i): raw for i in range(n)})
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_dense_keys_are_few_rows(spark):
    keys = spark.range(100_000).selectExpr("id AS key")
    assert key_bits.union([keys, keys]).count() == -(-100_000 // 64)
