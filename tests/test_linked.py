from functools import reduce

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from wavebook.operators import joins, linked, patch
from wavebook.plans.table_view import View

KEYS = st.sets(st.sampled_from("abcdefgh"))
SETTINGS = settings(
    max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def keys(spark, members):
    return None if members is None else spark.createDataFrame([(k,) for k in sorted(members)], "key string")


def members(frame):
    return {r.key for r in frame.collect()}


@SETTINGS
@given(st.lists(st.one_of(st.none(), KEYS), max_size=4))
def test_intersection(spark, sets):
    got = linked.intersect({str(i): keys(spark, s) for i, s in enumerate(sets)})
    active = [s for s in sets if s is not None]
    if not active:
        assert got is None
    else:
        assert members(got) == reduce(set.__and__, active)


@SETTINGS
@given(KEYS, KEYS)
def test_changes(spark, before, after):
    got = {r.key: r.change for r in linked.changes(keys(spark, before), keys(spark, after)).collect()}
    assert got == {**{k: "removed" for k in before - after}, **{k: "added" for k in after - before}}


def test_changes_from_and_to_nothing(spark):
    assert {r.change for r in linked.changes(None, keys(spark, "ab")).collect()} == {"added"}
    assert {r.change for r in linked.changes(keys(spark, "ab"), None).collect()} == {"removed"}


@pytest.mark.parametrize("twice", ["before", "after"])
def test_repeated_keys_are_an_error(spark, twice):
    double = spark.createDataFrame([("a",), ("a",)], "key string")
    single = keys(spark, "b")
    sides = (double, single) if twice == "before" else (single, double)
    with pytest.raises(Exception, match="duplicates"):
        linked.changes(*sides).collect()


def test_selections(spark):
    a, b = keys(spark, "ab"), keys(spark, "bc")
    assert members(linked.select(a, b)) == set("bc")
    assert members(linked.select(a, b, persistent=True)) == set("abc")
    assert linked.select(a, None, persistent=True) is None


def test_clearing(spark):
    filters = {"x": keys(spark, "a"), "y": keys(spark, "b")}
    assert list(linked.clear(filters, "x")) == ["y"]
    assert linked.intersect(linked.clear(filters)) is None


def test_sliders(spark):
    df = spark.createDataFrame(
        [("a", "2024-01-01 00:00:00", 1.0), ("b", "2024-01-02 12:00:00", None), ("c", "2024-01-03 00:00:00", 3.0)],
        "k string, t string, v double",
    ).withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert members(linked.slider_keys(df, "k", F.col("v"), 1, 3)) == set("ac")
    assert members(linked.slider_keys(df, "k", F.col("t"), "2024-01-02", "2024-01-03", "date")) == set("bc")
    assert members(linked.slider_keys(df, "k", F.col("t"), 1704067200, 1704196799, "datetime")) == set("a")
    assert members(linked.slider_keys(df, "k", F.col("v"), None, 2)) == set("a")


def test_lists_of_allowed_and_denied_ids():
    assert joins.selectable([1, 2, 3], []) == [1, 2, 3]
    assert joins.selectable([1, 2, 3], [2, 3, 4]) == [2, 3]
    assert joins.selectable([0, 1, 2], [0, -2]) == [1]


def test_unmatched_names(spark):
    a = spark.createDataFrame([("Korea",), ("Chile",), (None,), ("Korea",)], "country string")
    b = spark.createDataFrame([("South Korea",), ("Chile",)], "country string")
    got = {(r.key, r.side) for r in joins.unmatched(a, b, "country").collect()}
    assert got == {("Korea", "left only"), ("South Korea", "right only")}


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (3, "z", None)], "id int, s string, v double")


def test_edits(spark, people):
    edits = spark.createDataFrame(
        [(1, "s", None), (2, "v", "7.5"), (2, "s", "new"), (9, "s", "lost")], "row int, col string, value string"
    )
    got = [tuple(r) for r in patch.patch_cells(people, "id", edits, ["s", "v"]).orderBy("id").collect()]
    assert got == [(1, None, 1.0), (2, "new", 7.5), (3, "z", None)]


@pytest.mark.parametrize("edits, problem", [
    ([(1, "id", "5")], "not editable"), ([(1, "s", "a"), (1, "s", "b")], "two values"), ([(1, "v", "abc")], "abc"),
])
def test_refused_edits(spark, people, edits, problem):
    frame = spark.createDataFrame(edits, "row int, col string, value string")
    with pytest.raises(Exception, match=problem):
        patch.patch_cells(people, "id", frame, ["s", "v"]).collect()


def test_read_only_columns(spark, people):
    with pytest.raises(ValueError, match="not editable: s"):
        patch.patch_cells(people, "id", None, ["s"], read_only=["s"])


def test_appending(spark, people):
    more = spark.createDataFrame([(4, "w", 4.0)], "a int, b string, c double")
    assert patch.append_rows(people, more).count() == 4
    with pytest.raises(ValueError, match="3 columns"):
        patch.append_rows(people, more.drop("c"))


def test_a_view(spark, people):
    state = View("id", [("id", True)], search="z", columns=["id"], page_length=2)
    assert [tuple(r) for r in state.page(people, 1).collect()] == [(3,)]
    assert tuple(state.info(people).first()) == (1, 1, 1)
    assert View("id", [("id", True)], links={"k": keys(spark, "9")}).rows(
        people.withColumn("id", F.col("id").cast("string"))).count() == 0


def test_more_filters_than_bits_of_a_number(spark):
    every = {str(i): keys(spark, "abc" if i % 2 else "bcd") for i in range(70)}
    assert sorted(r.key for r in linked.intersect(every).collect()) == ["b", "c"]


def test_a_row_one_value_short_gets_its_name(spark, people):
    more = spark.createDataFrame([("w", 4.0)], "b string, c double")
    rows = patch.append_rows(people, more, row_name=F.lit(9))
    assert rows.count() == 4 and rows.where("s = 'w'").first()[0] == 9
    with pytest.raises(ValueError, match="3 columns"):
        patch.append_rows(people, more)
