import pathlib

import pytest
from pyspark.sql import functions as F

from wavebook.operators import edit_store, patch

ROWS = "k bigint, name string, score double, flag boolean"


def some_rows(spark, n=200):
    return spark.createDataFrame([(i, f"n{i}", i / 2, i % 2 == 0) for i in range(n)] + [(7, "again", None, None)], ROWS)


def cells(spark, *rows):
    return spark.createDataFrame(list(rows), "row bigint, col string, value string")


def listed(frame):
    return sorted(map(str, frame.collect()))


def files_of(path):
    return {str(f): f.stat().st_mtime_ns for f in pathlib.Path(path, "rows").rglob("*.parquet")}


@pytest.fixture
def store(spark, tmp_path):
    path = f"{tmp_path}/store"
    edit_store.create(some_rows(spark), "k", path, 8)
    return path


def test_reads_as_patched_before_and_after_compaction(spark, store):
    first = cells(spark, (3, "name", "x"), (3, "score", None), (7, "flag", "true"), (9999, "name", "nobody"))
    second = cells(spark, (3, "name", "y"), (4, "score", "1e3"))
    once = patch.patch_cells(some_rows(spark), "k", first, ["name", "score", "flag"])
    twice = patch.patch_cells(once, "k", second, ["name", "score"])
    assert listed(edit_store.read(spark, store)) == listed(some_rows(spark))
    assert edit_store.edit(spark, store, first) == 1
    assert listed(edit_store.read(spark, store)) == listed(once)
    assert edit_store.edit(spark, store, second) == 2
    expected = listed(twice)
    assert listed(edit_store.read(spark, store)) == expected
    assert edit_store.compact(spark, store)
    assert listed(edit_store.read(spark, store)) == expected and edit_store.compact(spark, store) == []
    assert edit_store.edit(spark, store, cells(spark, (3, "name", "z"))) == 3
    assert edit_store.read(spark, store).where("k = 3").first().name == "z"
    assert edit_store.read(spark, store).schema == some_rows(spark).schema


def test_compaction_writes_only_files_with_edited_keys(spark, store):
    before = files_of(store)
    edit_store.edit(spark, store, cells(spark, (3, "name", "x")))
    touched = edit_store.compact(spark, store)
    after = files_of(store)
    assert len(touched) == 1 and {f: after[f] for f in before} == before
    assert {f.split("/")[-2] for f in after.keys() - before.keys()} == {f"_part={touched[0]}"}
    read = {r[0] for r in edit_store.read(spark, store).select(F.input_file_name()).distinct().collect()}
    replaced = {f for f in before if f"_part={touched[0]}/" in f}
    assert {f.removeprefix("file://") for f in read} == after.keys() - replaced


def test_untouched_files_are_not_joined(spark, store):
    edit_store.edit(spark, store, cells(spark, (3, "name", "x")))
    plan = edit_store._Store(spark, store).rows([0, 1])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert len(edit_store._Store(spark, store).touched) == 1


def test_work_that_broke_off_does_not_count(spark, store, monkeypatch):
    edit_store.edit(spark, store, cells(spark, (3, "name", "x")))
    expected = listed(edit_store.read(spark, store))

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(edit_store, "put", fail)
        with pytest.raises(RuntimeError):
            edit_store.edit(spark, store, cells(spark, (5, "name", "never")))
        with pytest.raises(RuntimeError):
            edit_store.compact(spark, store)
    assert listed(edit_store.read(spark, store)) == expected
    edit_store.edit(spark, store, cells(spark, (6, "name", "later")))
    edit_store.compact(spark, store)
    names = {r.k: r.name for r in edit_store.read(spark, store).where("k in (3, 5, 6)").collect()}
    assert names == {3: "x", 5: "n5", 6: "later"}


@pytest.mark.parametrize("bad", [(3, "nope", "x"), (3, "k", "4"), (3, "name", "x"), (3, "score", "much"), (3, None, "x")])
def test_refused_edits_leave_the_table_alone(spark, store, bad):
    with pytest.raises(ValueError):
        edit_store.edit(spark, store, cells(spark, bad, (4, "score", "1")), read_only=["name"])
    with pytest.raises(ValueError, match="two values"):
        edit_store.edit(spark, store, cells(spark, (3, "score", "1"), (3, "score", "2")))
    assert listed(edit_store.read(spark, store)) == listed(some_rows(spark))


def test_empty_tables_and_edits(spark, tmp_path):
    path = f"{tmp_path}/empty"
    edit_store.create(some_rows(spark).limit(0), "k", path, 4)
    edit_store.edit(spark, path, cells(spark, (3, "name", "x")))
    assert edit_store.read(spark, path).count() == 0
    edit_store.compact(spark, path)
    edit_store.edit(spark, path, cells(spark))
    assert edit_store.read(spark, path).count() == 0 and edit_store.compact(spark, path) == []
    with pytest.raises(ValueError, match="already"):
        edit_store.create(some_rows(spark), "k", path, 4)


def test_missing_keys_and_a_hot_key(spark, tmp_path):
    path = f"{tmp_path}/hot"
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), F.lit("a").alias("v")
    )
    edit_store.create(df, "k", path, 4)
    edit_store.edit(spark, path, cells(spark, (5, "v", "b")))
    edit_store.compact(spark, path)
    counts = edit_store.read(spark, path).groupBy(F.col("k").eqNullSafe(5).alias("hot"), "v").count()
    got = {(r.hot, r.v): r["count"] for r in counts.collect()}
    assert got == {(True, "b"): 1000, (False, "a"): 2000}
