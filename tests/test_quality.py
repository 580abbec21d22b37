import duckdb
import pytest
from pyspark.sql import functions as F

from wavebook.operators import quality

SCHEMA = "k bigint, word string, share double, list array<int>"
ROWS = [
    (1, "a", 0.5, [1, 2]), (1, "a", 0.5, [1, 2]), (1, "a", None, [1, 2]), (2, None, 0.5, None), (2, None, 0.5, None),
    (None, "a", 0.5, [1]), (None, None, None, None), (None, None, None, None), (3, "b", 0.0, []), (3, "b", -0.0, []),
    (4, "b", float("nan"), [None, 1]), (4, "b", float("nan"), [1, None]), (5, "", 0.5, [1]),
]


def numbers(frame):
    return tuple(frame.select("n_rows", "n_distinct", "n_keys", "key_is_unique").first())


def plain(df, keys):
    return (
        df.count(), df.distinct().count(), df.select(*keys).distinct().count(),
        df.count() == df.select(*keys).distinct().count(),
    )


@pytest.mark.parametrize("keys", [["k"], ["word", "share"], ["k", "word", "share", "list"]])
def test_nulls_copies_and_signed_zeros(spark, keys):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert numbers(quality.audit(df, "t", keys)) == plain(df, keys)


@pytest.mark.parametrize("keys", [["k"], ["word"]])
def test_colliding_fingerprints_are_told_apart(spark, monkeypatch, keys):
    monkeypatch.setattr(quality, "fingerprint", lambda names: [F.lit(1).alias("_a"), F.lit(2).alias("_b")])
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert numbers(quality.audit(df, "t", keys)) == plain(df, keys)


def test_nulls_in_other_places_are_other_fingerprints(spark):
    df = spark.createDataFrame([(None, 1), (1, None)], "x int, y int")
    assert df.select(*quality.fingerprint(["x", "y"])).distinct().count() == 2


def test_empty_table_and_awkward_names(spark):
    df = spark.createDataFrame([], "`a.b` int, `_n` string")
    assert numbers(quality.audit(df, "t", ["a.b"])) == (0, 0, 0, True)
    df = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y")], "`a.b` int, `_a` string")
    assert numbers(quality.audit(df, "t", ["a.b"])) == (3, 2, 1, False)


def test_hot_copies(spark, tmp_path):
    """A third of the rows are copies of one row, in many tasks."""
    path = f"{tmp_path}/t.parquet"
    duckdb.execute(f"""
      COPY (SELECT CASE WHEN i % 3 = 0 THEN 0 ELSE i % 5000 END AS k, CASE WHEN i % 3 = 0 THEN 'x' ELSE 'y' || i END AS v
            FROM range(60000) t(i)) TO '{path}' (FORMAT parquet)""")
    df = spark.read.parquet(path).repartition(16)
    assert numbers(quality.audit(df, "t", ["k"])) == plain(df, ["k"])


def test_unique_rows_are_not_shuffled_whole(spark):
    """Without repeated fingerprints nothing is joined and no wide column leaves its task."""
    df = spark.range(1000).select("id", F.repeat(F.col("id").cast("string"), 50).alias("wide"))
    report = quality.audit(df, "t", ["id"])
    assert numbers(report) == (1000, 1000, 1000, True)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "wide" not in plan and "Union" not in plan
