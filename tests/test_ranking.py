"""Row numbers, running totals and what is built on them, against plain Python."""

from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from wavebook.operators import aggregate, inequality, joins, ranking, view

SETTINGS = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
GROUPS = st.sampled_from(["a", "b", "c", None])
ROWS = st.lists(st.tuples(GROUPS, st.integers(0, 30)), min_size=1, max_size=60)


@SETTINGS
@given(ROWS)
def test_row_numbers(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, g string, v int")
    numbered = ranking.number_rows(df.repartition(5), [F.col("v").desc(), "id"]).collect()
    expected = {i: n for n, (i, _) in enumerate(sorted(enumerate(rows), key=lambda r: (-r[1][1], r[0])), 1)}
    assert {r.id: r.row_id for r in numbered} == expected


@SETTINGS
@given(ROWS)
def test_running_totals(spark, rows):
    counts = Counter(rows)
    df = spark.createDataFrame([(g, v, n) for (g, v), n in counts.items()], "g string, v int, n int")
    got = {(r.g, r.v): (r.n_before, r.n_total) for r in ranking.running_totals(df, ["g"], "v", ["n"]).collect()}
    expected = {
        (g, v): (sum(n for (h, w), n in counts.items() if h == g and w < v),
                 sum(n for (h, _), n in counts.items() if h == g))
        for g, v in counts
    }
    assert got == expected


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 9)), min_size=1, max_size=40))
def test_inequality_measures(spark, rows):
    groups = defaultdict(list)
    for g, x in rows:
        groups[g].append(x)
    df = spark.createDataFrame([(g, float(x)) for g, x in rows], "g string, x double")
    ginis = {r.g: r.gini for r in inequality.gini(df, ["g"], "x").collect()}
    ratios = {r.g: r for r in inequality.quintile_ratio(df, ["g"], "x").collect()}
    for g, xs in groups.items():
        xs.sort()
        n = len(xs)
        gini = sum((2 * i - n - 1) * x for i, x in enumerate(xs, 1)) / (n * sum(xs))
        assert ginis[g] == pytest.approx(gini, abs=1e-12)
        bottom = sum(xs[: -(-n // 5)])
        top = sum(xs[n - n // 5 :]) if n >= 5 else 0
        assert ratios[g].s80s20 == pytest.approx(top / bottom)


@SETTINGS
@given(ROWS)
def test_pages_put_together_are_the_table(spark, rows):
    df = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "id int, v int").cache()
    order = [("v", True), ("id", False)]
    pages = -(-len(rows) // 25)
    for shallow in (0, 10_000):
        got = [
            sorted(((r.v, r.id) for r in view.page(df, order, p, 25, shallow).collect()), key=lambda r: (-r[0], r[1]))
            for p in range(1, pages + 1)
        ]
        assert sum(got, []) == sorted(((r[1], i) for i, r in enumerate(rows)), key=lambda r: (-r[0], r[1]))
        with pytest.raises(ValueError):
            view.page(df, order, pages + 1, 25, shallow)
    with pytest.raises(ValueError):
        view.page(df, order, 0, 25)
    df.unpersist()


def test_orders_are_required(spark):
    for call in (lambda: ranking.number_rows(spark.range(3), []), lambda: ranking.first_rows(spark.range(3), [], 1)):
        with pytest.raises(ValueError):
            call()


def test_large_row_cap(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SHALLOW_ROWS", 10)
    got = ranking.first_rows(spark.range(1000).repartition(7), ["id"], 220)
    assert sorted(r.id for r in got.collect()) == list(range(220))


def test_row_blocks(spark):
    df = spark.createDataFrame([(k, v) for k, v in zip("abcdef", [3, 1, 2, 2, 9, 5])], "k string, v int")
    order = [("v", True), ("k", False)]  # e f a c d b
    block = lambda a, b: "".join(sorted(r.k for r in view.row_block(df, "k", a, b, order).collect()))
    assert block("f", "d") == "acdf" and block("d", "f") == "acdf"
    assert block("c", "c") == "c" and block("e", "b") == "abcdef" and block("c", "d") == "cd"
    assert block("a", "zz") == ""


def test_frequencies(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "x string")
    rows = {r.value: tuple(r)[1:] for r in aggregate.frequency(df, "x").collect()}
    assert rows == {
        "a": (1, 25.0, 33.33, 33.33), "b": (2, 50.0, 66.67, 100.0), None: (1, 25.0, None, None),
    }


@pytest.mark.parametrize("limit", [0, 1000])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_rows_of_a_hot_group_are_joined(spark, limit, how):
    """A third of all rows in one group, some in none; broadcast and salted joins give the same."""
    df = spark.range(30000).select(
        F.when(F.col("id") < 10000, "hot").when(F.col("id") < 11000, None).otherwise(
            (F.col("id") % 4000).cast("string")).alias("g"),
        "id",
    )
    means = df.groupBy("g").agg(F.count("*").alias("n")).where("g is null or g <> '17'")
    joined = joins.sized_join(df, means, ["g"], how, broadcast_rows=limit, salts=8)
    got = sorted(map(tuple, joined.collect()), key=lambda r: r[1])
    rows = [("hot" if i < 10000 else None if i < 11000 else str(i % 4000), i) for i in range(30000)]
    sizes = Counter(g for g, _ in rows)
    known = lambda g: g != "17"
    expected = {
        "left": [(g, i, sizes[g] if known(g) else None) for g, i in rows],
        "inner": [(g, i, sizes[g]) for g, i in rows if known(g)],
        "left_semi": [r for r in rows if known(r[0])],
        "left_anti": [r for r in rows if not known(r[0])],
    }
    assert got == expected[how]


def test_hot_keys(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"))
    five = spark.range(1).select(F.xxhash64(F.lit(5).cast("long"))).first()[0]
    assert joins.hot_keys(df, ["k"]) == [five]
    assert joins.hot_keys(spark.range(30000), ["id"]) == []


def test_missing_keys_do_not_match_in_lookups(spark):
    df = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    codes = spark.createDataFrame([(None, "x"), (2, "y")], "k int, c string")
    for limit in (0, 10):
        got = joins.sized_join(df, codes, ["k"], "left", False, False, broadcast_rows=limit)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == [(None, 1, None), (2, 2, "y")]


@pytest.mark.parametrize("shallow", [0, 10_000])
def test_pages_with_missing_values_are_complete(spark, shallow):
    df = spark.range(3000).select(F.when(F.col("id") % 10 > 0, F.col("id") % 97).alias("v"), "id")
    want = sorted(((r.v is not None, r.v or 0, -r.id), r.id) for r in df.collect())
    order = [("v", False), ("id", True)]
    for number in (1, 2, 7, 30):
        got = view.page(df, order, number, 100, shallow)
        assert sorted(r.id for r in got.collect()) == sorted(i for _, i in want[(number - 1) * 100 : number * 100])
    falling = view.page(df, [("v", True), ("id", False)], 30, 100, shallow)
    assert {r.v for r in falling.collect()} == {None}


@pytest.mark.parametrize("shallow", [0, 10_000])
def test_a_shared_place_is_an_error(spark, shallow):
    df = spark.range(2000).select((F.col("id") / 2).cast("int").alias("v"))
    with pytest.raises(ValueError, match="same place"):
        view.page(df, [("v", False)], 5, 10, shallow)
    with pytest.raises(ValueError, match="same place"):
        view.row_block(df.withColumn("k", F.monotonically_increasing_id()), "v", 3, 9, [("v", False)])


def test_blocks_with_missing_values(spark):
    rows = [(k, v) for k, v in zip("abcdefgh", [5, None, 3, None, 1, 9, 7, 2])]
    df = spark.createDataFrame(rows, "k string, v int")
    for falling in (False, True):
        order = [("v", falling), ("k", False)]
        known = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1] if falling else r[1], r[0]))
        none = sorted(r for r in rows if r[1] is None)
        shown = [k for k, _ in (known + none if falling else none + known)]
        for a in "abch":
            for b in "bdef":
                i, j = sorted((shown.index(a), shown.index(b)))
                got = sorted(r.k for r in view.row_block(df, "k", a, b, order).collect())
                assert got == sorted(shown[i : j + 1]), (falling, a, b)
