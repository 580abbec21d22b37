import pytest
from pyspark.sql import functions as F

from wavebook.operators import codebook
from wavebook.sources import labelled

BOOK = [
    ("id", "1", "one, \"quoted\"", 1), ("id", "2", "zwei äöü", 2), ("s", None, "Text\nof two lines", 0),
    ("v", None, "", 0), ("v", "1.5", "one and a half", 1),
]


def frame(spark):
    df = spark.createDataFrame([(1, "a", 1.5, True), (2, None, None, None), (1, "b,c", 2.0, False)], "id smallint, s string, v double, flag boolean")
    df = codebook.set_variable_labels(df, s="Text\nof two lines", v="")
    return codebook.set_value_labels(df, id={1: 'one, "quoted"', 2: "zwei äöü"}, v={1.5: "one and a half"})


def book_of(df):
    return sorted(map(tuple, codebook.from_metadata(df).collect()), key=str)


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_labels_types_and_rows_come_back(spark, tmp_path, kind):
    df, path = frame(spark), f"{tmp_path}/t.{kind}"
    labelled.write_labelled(df, path)
    back = labelled.read_labelled(spark, path)
    assert book_of(back) == book_of(df) == sorted(BOOK, key=str)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in df.schema]
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    # And once more, from what was read.
    labelled.write_labelled(back, f"{tmp_path}/again.{kind}")
    assert book_of(labelled.read_labelled(spark, f"{tmp_path}/again.{kind}")) == book_of(df)


def test_a_codebook_table_wins_over_metadata_and_survives_joins(spark, tmp_path):
    df = frame(spark)
    cleaned = codebook.clean(codebook.from_metadata(df))
    plain = df.groupBy("id").agg(F.count("*").alias("n"))
    labelled.write_labelled(plain, f"{tmp_path}/t.parquet", cleaned.where("variable = 'id'"))
    back = labelled.read_labelled(spark, f"{tmp_path}/t.parquet")
    named = codebook.decode(back, labelled.saved_codebook(spark, f"{tmp_path}/t.parquet"), "id", "label")
    assert {(r.id, r.n, r.label) for r in named.collect()} == {(1, 2, 'one, "quoted"'), (2, 1, "zwei aou")}


def test_no_labels_of_an_older_save(spark, tmp_path):
    path = f"{tmp_path}/t.csv"
    labelled.write_labelled(frame(spark), path)
    with pytest.raises(Exception, match="already exists"):
        labelled.write_labelled(frame(spark), path)
    labelled.write_labelled(spark.range(3).withColumn("id", F.col("id").cast("int")), path, mode="overwrite")
    back = labelled.read_labelled(spark, path)
    assert book_of(back) == [] and back.count() == 3 and back.dtypes == [("id", "int")]


def test_labels_that_nobody_would_find_are_an_error(spark, tmp_path):
    book = codebook.codebook(spark, {"other": {1: "x"}})
    with pytest.raises(ValueError, match="other"):
        labelled.write_labelled(spark.range(1), f"{tmp_path}/a.parquet", book)
    twice = book.unionAll(book).withColumn("variable", F.lit("id"))
    with pytest.raises(ValueError, match="twice"):
        labelled.write_labelled(spark.range(1), f"{tmp_path}/b.parquet", twice)


def test_tables_with_nothing_beside_them(spark, tmp_path):
    path = f"{tmp_path}/t.json"
    spark.range(2).write.json(path)
    with pytest.raises(ValueError, match="schema"):
        labelled.read_labelled(spark, path)
    assert labelled.read_labelled(spark, path, "id bigint").count() == 2
    assert labelled.saved_codebook(spark, path).count() == 0


def test_an_empty_table_and_a_large_codebook(spark, tmp_path, monkeypatch):
    empty = frame(spark).where("id > 5")
    labelled.write_labelled(empty, f"{tmp_path}/t.orc")
    back = labelled.read_labelled(spark, f"{tmp_path}/t.orc")
    assert back.count() == 0 and book_of(back) == sorted(BOOK, key=str)
    monkeypatch.setattr(labelled, "LABELS_IN_SCHEMA", 3)
    with pytest.raises(ValueError, match="join the codebook"):
        labelled.read_labelled(spark, f"{tmp_path}/t.orc")
