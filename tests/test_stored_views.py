import random

import pytest
from pyspark.sql import functions as F

from wavebook.operators import predicates, search_index, stored_order, view

ORDER = [("v", True), ("id", False)]


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(4)
    rows = [(i, None if i % 17 == 0 else 7.0 if i % 3 == 0 else rng.choice([0.0, -1.5, float(i)]), f"t{i}") for i in range(1000)]
    # As stored in the very order that is asked for, which one partition's sample would not show.
    return spark.createDataFrame(rows, "id bigint, v double, t string").orderBy(F.col("v").desc(), "id").repartition(5)


@pytest.mark.parametrize("rows_per_file", [37, 400, 5000])
def test_every_page_is_the_page_of_the_sorted_table(spark, numbers, tmp_path, rows_per_file):
    path = str(tmp_path / "stored")
    stored_order.store_order(numbers, ORDER, path, rows_per_file)
    want = [tuple(r) for r in numbers.orderBy(*view.sort_columns(ORDER)).collect()]
    assert tuple(stored_order.stored_info(spark, path, 30).first()) == (1000, 34)
    for number in (1, 2, 13, 33, 34):
        page = stored_order.stored_page(spark, path, number, 30)
        assert sorted(map(str, map(tuple, page.collect()))) == sorted(map(str, want[30 * (number - 1) : 30 * number]))
    for number in (0, 35):
        with pytest.raises(ValueError, match="out of range"):
            stored_order.stored_page(spark, path, number, 30)


def test_a_page_reads_the_files_that_hold_it(spark, numbers, tmp_path, monkeypatch):
    path = str(tmp_path / "stored")
    stored_order.store_order(numbers, ORDER, path, 50)
    sizes = [r["rows"] for r in spark.read.parquet(f"{path}/manifest").collect()]
    assert len(sizes) >= 15 and max(sizes) < 200 and sum(sizes) == 1000
    read = []
    monkeypatch.setattr(stored_order, "number_rows", lambda df, *rest: read.append(df) or number_rows(df, *rest))
    number_rows = view.number_rows
    stored_order.stored_page(spark, path, 40, 20).count()
    plan = read[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_range" in plan and "Window" not in plan
    assert len({f.split("_range=")[1].split("/")[0] for f in read[0].inputFiles()}) <= len(sizes)


def test_ties_empty_tables_and_own_names(spark, numbers, tmp_path):
    stored_order.store_order(numbers, [("v", False)], str(tmp_path / "ties"), 100)
    with pytest.raises(ValueError, match="same place"):
        stored_order.stored_page(spark, str(tmp_path / "ties"), 2, 30)
    stored_order.store_order(numbers.where("id < 0"), ORDER, str(tmp_path / "none"))
    assert tuple(stored_order.stored_info(spark, str(tmp_path / "none"), 30).first()) == (0, 0)
    with pytest.raises(ValueError, match="out of range"):
        stored_order.stored_page(spark, str(tmp_path / "none"), 1, 30)
    with pytest.raises(ValueError, match="own"):
        stored_order.store_order(numbers.withColumn("_RANGE", F.lit(1)), ORDER, str(tmp_path / "own"))
    with pytest.raises(ValueError, match="own"):
        search_index.build_index(numbers.withColumn("_Row", F.lit(1)), str(tmp_path / "own"))


QUERIES = ["red econ", "  Red ", "no such word", "é漢字", "ab", "a b", "", "12", "t99", "NULL", "😀x", "x😀", "red red", "İstanbul"]


def texts(spark):
    rng = random.Random(8)
    words = ["red", "Econ", "blue", "été", "É漢字", "x😀x", "economy", "tired", "İstanbul", None, "a b", "1 2", "line\nred"]
    rows = [(i, rng.choice(words), rng.choice(words), rng.choice([0.5, 12.0, None])) for i in range(600)]
    return spark.createDataFrame(rows + rows[:5], "id bigint, a string, b string, v double").repartition(3)


def found(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_searches_through_the_index_and_after_an_append(spark, tmp_path):
    rows, path = texts(spark), str(tmp_path / "index")
    search_index.build_index(rows.where("id % 3 > 0"), path, rows_per_block=50)
    for query in QUERIES[:3]:
        assert found(search_index.search(spark, path, query)) == found(predicates.search_everywhere(rows.where("id % 3 > 0"), query))
    before = set(spark.read.parquet(f"{path}/rows").inputFiles())
    search_index.append_to_index(rows.where("id % 3 = 0").select("v", "b", "a", "id"), path, rows_per_block=50)
    assert before < set(spark.read.parquet(f"{path}/rows").inputFiles())
    for query in QUERIES:
        assert found(search_index.search(spark, path, query)) == found(predicates.search_everywhere(rows, query)), query
    for query, regex, ignore in (("Econ", False, False), ("É漢字", False, False), (r"^\d+ red", True, True), ("red.*Econ", True, False)):
        got = search_index.search(spark, path, query, regex, ignore)
        assert found(got) == found(predicates.search_everywhere(rows, query, regex, ignore)), query


def test_a_rare_word_reads_a_small_share(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    rows = spark.range(4000).withColumn("t", F.concat(F.lit("common text of row "), F.col("id").cast("string")))
    rows = rows.withColumn("t", F.when(F.col("id") == 1234, "a zebra").otherwise(F.col("t")))
    search_index.build_index(rows, path, rows_per_block=100)
    hits = search_index.search(spark, path, "zebra")
    assert [r.id for r in hits.collect()] == [1234]
    assert search_index.candidates(spark, path, search_index.trigrams("zebra")).count() == 1
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PushedFilters: [In(trigram" in plan.replace("IsNotNull(_block), ", "")
    # Every row has these, so each of the 40 blocks has full postings; the result is whole.
    monkeypatch.setattr(search_index, "BLOCKS_LISTED", 3)
    assert search_index.search(spark, path, "common text").count() == 3999


def test_an_empty_index_that_grows(spark, tmp_path):
    rows, path = texts(spark), str(tmp_path / "index")
    search_index.build_index(rows.where("id < 0"), path)
    assert search_index.search(spark, path, "red").count() == 0 == search_index.search(spark, path, "").count()
    search_index.append_to_index(rows, path)
    assert found(search_index.search(spark, path, "tired red")) == found(predicates.search_everywhere(rows, "tired red"))


def test_an_append_that_broke_off_does_not_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    first, more = (spark.createDataFrame([(w,)], "t string") for w in ("red one", "red two"))
    search_index.build_index(first, path)
    with monkeypatch.context() as broken:
        broken.setattr(search_index, "row_text", lambda *_: F.raise_error(F.lit("lost")).cast("string"))
        with pytest.raises(Exception, match="lost"):
            search_index.append_to_index(more, path)
    assert found(search_index.search(spark, path, "red")) == ["('red one',)"]
    search_index.append_to_index(more, path)
    assert found(search_index.search(spark, path, "red")) == ["('red one',)", "('red two',)"]
    assert found(search_index.search(spark, path, "re")) == ["('red one',)", "('red two',)"]
    with pytest.raises(ValueError, match="already"):
        search_index.build_index(first, path)
    with pytest.raises(ValueError, match="columns"):
        search_index.append_to_index(spark.range(2), path)
