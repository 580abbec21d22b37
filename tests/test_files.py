import glob

import pytest
from pyspark.sql import functions as F

from wavebook.operators import codebook, predicates, quality, reshape
from wavebook.plans.country_files import publish, with_country
from wavebook.session import checkpoint_root
from wavebook.sources import exports, files


@pytest.mark.parametrize("kind, compression", [("parquet", "zstd"), ("csv", "bzip2"), ("json", "gzip"), ("orc", None)])
def test_writing_by_extension(spark, tmp_path, kind, compression):
    df = spark.createDataFrame([(1, "a,b", 1.5), (2, None, None)], "id int, s string, v double")
    book = codebook.codebook(spark, {"id": {1: "one", 2: "two"}}, {"s": "Text"})
    path = f"{tmp_path}/out.{kind}"
    files.write_table(df, path, book, compression=compression)
    back = files.read_table(spark, path, "id int, s string, v double")
    assert sorted(map(tuple, back.collect())) == [(1, "a,b", 1.5), (2, None, None)]
    assert spark.read.parquet(f"{path}.codebook.parquet").count() == 3


def test_unknown_extension(spark, tmp_path):
    with pytest.raises(ValueError, match="no writer"):
        files.write_table(spark.range(1), f"{tmp_path}/x.sav")


def test_encoding_and_headers(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes("Series Name,Value\nCôte d'Ivoire,1\n".encode("latin1"))
    df = files.read_csv(spark, f"{tmp_path}/in.csv", "`Series Name` string, Value double",
                        {"Series Name": "series"}, "ISO-8859-1")
    assert tuple(df.first()) == ("Côte d'Ivoire", 1.0)


def test_discovery(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "ESS10.zip").write_bytes(b"12345")
    (tmp_path / "a" / "other.txt").write_bytes(b"1")
    found = files.discover(spark, str(tmp_path), "*ESS10.zip").collect()
    assert [(r.file, r.n_bytes) for r in found] == [("ESS10.zip", 5)]
    assert found[0].path.endswith("/a/b/ESS10.zip")
    assert files.discover(spark, f"{tmp_path}/missing", "*").count() == 0


def test_a_large_country_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(60000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("C"), F.col("id") % 20)).alias("code"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256KB")
    try:
        exports.split_export(rows, "code", f"{tmp_path}/out", "X/x")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(glob.glob(f"{tmp_path}/out/file=x_HOT.sav/*.parquet")) > 1
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 60000 and back.where("code = 'HOT'").count() == 20000


def test_survey_to_country_files(spark, tmp_path):
    survey = spark.createDataFrame(
        [(826, "GBR", 1), (909, "NIR", 2), (32, "ARG", 3), (999, "XXX", 4)], "B_COUNTRY int, alpha string, Q6 int"
    )
    book = codebook.codebook(
        spark, {"B_COUNTRY": {826: "Great Britain", 909: "Northern Ireland", 32: "Argentina", 999: "Nowhere"}}
    )
    codes = spark.createDataFrame([("GB", "GBR"), ("AR", "ARG")], "iso2 string, iso3 string")
    named = with_country(survey, book, codes, "B_COUNTRY", "alpha", "iso3")
    got = {(r.Q6, r.country, r.country_iso2, r.country_iso3) for r in named.collect()}
    assert got == {
        (1, "United Kingdom", "GB", "GBR"), (2, "United Kingdom", "GB", "GBR"), (3, "Argentina", "AR", "ARG"),
        (4, "Nowhere", None, "XXX"),
    }
    lines = publish(named, f"{tmp_path}/wvs7", "WVS7/wvs7", "/files/", "B_COUNTRY")
    assert [r.line[:40] for r in lines.orderBy("ord").collect()] == [
        "<!-- generated from WVS7/wvs7.sav -->", '<li><a class="dropdown-item" href="/file',
        '<!-- <li><a class="dropdown-item" href="', '<li><a class="dropdown-item" href="/file',
    ]
    exports.write_manifest(lines, f"{tmp_path}/{exports.manifest_name('WVS7/wvs7')}")
    assert spark.read.text(f"{tmp_path}/_wvs7-country-links.md").count() == 4
    with pytest.raises(Exception, match="no country_iso3, so no file"):
        lost = named.withColumn("country_iso3", F.nullif("country_iso3", F.lit("ARG")))
        publish(lost, f"{tmp_path}/lost", "WVS7/wvs7", "/files/", "B_COUNTRY")


def test_checkpoint_folder_of_the_session_is_used(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert configured in checkpoint_root(spark)


def test_audit_and_contract(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, v string")
    assert tuple(quality.audit(df, "t", ["k"]).first()) == ("t", 5, 4, 3, False)
    assert tuple(quality.audit(df.where("k is null"), "t", ["k"]).first()) == ("t", 1, 1, 1, True)
    assert tuple(quality.audit(df.limit(0), "t", ["k"]).first()) == ("t", 0, 0, 0, True)
    checks = quality.contract({"a": (df, 5, 2), "b": (df, 4, 2), "c": (df, None, 3)})
    assert {r.table_name: r.as_expected for r in checks.collect()} == {"a": True, "b": False, "c": False}


def test_arrays(spark):
    df = spark.createDataFrame([(1, [1, 2], ["x", None]), (2, [], [])], "id int, a array<int>, b array<string>")
    got = [tuple(r) for r in reshape.arrays_to_rows(df, ["id"], ["a", "b"]).collect()]
    assert got == [(1, 0, 1, "x"), (1, 1, 2, None)]
    uneven = spark.createDataFrame([(1, [1, 2], ["x"])], "id int, a array<int>, b array<string>")
    with pytest.raises(Exception, match="same length"):
        reshape.arrays_to_rows(uneven, ["id"], ["a", "b"]).collect()
    grid = spark.createDataFrame([([[1, 2, 3], [4, 5, 6]],), ([],)], "g array<array<int>>")
    turned = [r[0] for r in grid.select(reshape.transpose(F.col("g"))).collect()]
    assert turned == [[[1, 4], [2, 5], [3, 6]], []]


def test_search(spark):
    df = spark.createDataFrame([("Red Ring", 900.0, None), ("blue", 1.5, "ring red")], "n string, p double, t string")
    found = lambda q, **k: predicates.search_everywhere(df, q, **k).count()
    assert found("red RING") == 2 and found("red blue") == 1 and found("") == 2
    assert found("red", ignore_case=False) == 1 and found("900.0") == 0 and found("900") == 1
    assert found("^red", regex=True) == 1 and found("r.d r", regex=True, ignore_case=False) == 0
