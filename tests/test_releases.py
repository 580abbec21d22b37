import pathlib

import pytest
from pyspark.sql import functions as F

from wavebook.sources import releases

SCHEMA = "code string, name string, ord int, score double"


def survey(spark, *rows):
    given = [("ARG", "Argentina", 1, 0.5), ("ARG", "Argentina", 1, None), ("BEL", "Belgium", 2, 1.0), ("CHE", "Switzerland", 3, 2.0)]
    return spark.createDataFrame([*given, *rows], SCHEMA)


def publish(df, path):
    return releases.publish_release(df, path, "ESS10/ess10", "code", "name", "ord")


def runs(listed):
    return {r.code: int(r.run.split("-")[0]) for r in listed.collect()}


def rows(spark, path, **which):
    return sorted(map(str, releases.read_release(spark, path, survey(spark).schema, **which).collect()))


def listed(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def path(tmp_path):
    return f"{tmp_path}/published"


def files_of(path):
    return {str(f): f.stat().st_mtime_ns for f in pathlib.Path(path, "files").rglob("*.parquet")}


def test_only_changed_countries_are_written(spark, path):
    first = survey(spark)
    assert runs(publish(first, path)) == {"ARG": 0, "BEL": 0, "CHE": 0}
    before = files_of(path)
    second = survey(spark, ("BEL", "Belgium", 2, 3.0), ("DNK", "Denmark", 4, 1.0)).where("code <> 'CHE'")
    assert runs(publish(second.repartition(3), path)) == {"ARG": 0, "BEL": 1, "DNK": 1}
    after = files_of(path)
    assert {f: after[f] for f in before} == before
    assert {f.split("file=")[1].split("/")[0] for f in after.keys() - before.keys()} == {"ess10_BEL.sav", "ess10_DNK.sav"}
    assert rows(spark, path) == listed(second) and rows(spark, path, number=0) == listed(first)
    # Nothing changed: no file is written, in whatever order the rows come.
    assert runs(publish(second.orderBy(F.rand(1)), path)) == {"ARG": 0, "BEL": 1, "DNK": 1} and files_of(path) == after


@pytest.mark.parametrize("step", ["split_export", "stored_files", "put"])
def test_a_run_that_fails_midway_leaves_the_old_release_whole(spark, path, monkeypatch, step):
    publish(survey(spark), path)
    old = rows(spark, path)
    kept = getattr(releases, step)
    changed = survey(spark, ("BEL", "Belgium", 2, 3.0))

    def half(*given):
        if step == "split_export":
            kept(given[0].where("code <> 'BEL'"), *given[1:])
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(releases, step, half)
        with pytest.raises(RuntimeError):
            publish(changed, path)
    assert rows(spark, path) == old
    assert runs(publish(changed, path))["BEL"] == 1 and rows(spark, path) == listed(changed)


def test_a_link_without_a_file_is_not_released(spark, path, monkeypatch):
    publish(survey(spark), path)
    kept = releases.split_export
    monkeypatch.setattr(releases, "split_export", lambda df, *rest: kept(df.where("code <> 'DNK'"), *rest))
    with pytest.raises(ValueError, match="ess10_DNK.sav"):
        publish(survey(spark, ("DNK", "Denmark", 4, 1.0)), path)
    assert rows(spark, path) == listed(survey(spark))


def test_rows_without_a_code_and_taken_names(spark, path):
    with pytest.raises(Exception, match="no code"):
        publish(survey(spark, (None, "?", 9, 1.0)), path)
    with pytest.raises(ValueError, match="own"):
        publish(survey(spark).withColumn("File", F.lit(1)), path)
    with pytest.raises(ValueError, match="no release"):
        releases.release(spark, path)


def test_an_empty_survey_and_values_that_move(spark, path):
    assert publish(survey(spark).limit(0), path).count() == 0 and rows(spark, path) == []
    publish(survey(spark), path)
    gone = F.when(F.col("code") != "BEL", F.col("score"))
    assert runs(publish(survey(spark).withColumn("score", gone), path)) == {"ARG": 1, "BEL": 2, "CHE": 1}
    # Another type of a column is another file.
    other = survey(spark).withColumn("score", F.col("score").cast("float"))
    assert set(runs(publish(other, path)).values()) == {3}
