"""Places where a plain Spark expression would give another result."""

import pytest
from pyspark.sql import functions as F

from wavebook.functions import formats, text
from wavebook.operators import aggregate, codebook, joins, linked, pick, predicates, recode, reshape
from wavebook.plans import trust
from wavebook.sources.exports import manifest


def rows(frame, *order):
    return [tuple(r) for r in frame.orderBy(*(order or frame.columns)).collect()]


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_missing_country_never_passes_the_cutoff(spark):
    df = spark.createDataFrame(
        [("Brazil", 2016), ("Brazil", 2017), ("Chile", 2013), ("Chile", 2016), (None, 2000)],
        "country string, year int",
    )
    kept = df.where(predicates.until(F.col("year"), F.col("country"), 2013, {"Brazil": 2016}))
    assert rows(kept) == [("Brazil", 2016), ("Chile", 2013)]


def test_missing_parts_are_pasted_as_text(spark):
    df = spark.createDataFrame(
        [("WVS", 3, None), ("EVS", None, 2), ("EVS", None, None)], "survey string, w int, other int"
    )
    key = text.paste(F.col("survey"), F.coalesce("w", "other"))
    assert [r[0] for r in df.select(key).collect()] == ["WVS3", "EVS2", "EVSNA"]


def test_first_row_needs_an_order(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(ValueError):
        pick.first_per_key(df, ["k"], [])
    assert rows(pick.first_per_key(df, ["k"], [F.col("v").desc()])) == [("a", 2)]


def test_halves_round_to_even(spark):
    assert value(spark, formats.round_half_even(F.lit(0.125), 2)) == 0.12
    assert value(spark, formats.round_half_even(F.lit(2.5), 0)) == 2.0
    assert value(spark, formats.round_by_factor(F.lit(0.125), 2)) == 0.13
    assert value(spark, formats.round_by_factor(F.lit(-2.5), 0)) == -2.0


def test_mean_of_nothing_is_missing(spark):
    df = spark.createDataFrame([("a", "h", None), ("a", "l", 2.0), ("b", "h", 6.0), ("b", "l", 3.0)],
                               "c string, s string, v double")
    means = aggregate.period_means(df, ["c"], "s", "v", {"h": "h", "l": "l"})
    ratio = means.select("c", aggregate.guarded_ratio(F.col("h"), F.col("l")).alias("r"))
    assert rows(ratio) == [("a", None), ("b", 2.0)]
    assert value(spark, aggregate.guarded_ratio(F.lit(1.0), F.lit(0.0))) is None


def test_a_group_with_only_yes_is_100_percent(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", 2), ("c", None)], "g string, a int")
    df = df.withColumn("trust", recode.reverse_scale(F.col("a"), 2))
    shares = aggregate.answer_share(df, ["g"], "trust")
    assert rows(shares) == [("a", 100.0, 2, 2), ("b", 0.0, 0, 2), ("c", None, 0, 0)]


INDICATORS = [
    ("X", "XX", 2010, "g", 1.0), ("X", "XX", 2012, "s", 2.0),
    ("Y", "YY", 2012, "g", 3.0), ("Y", "YY", 2012, "s", 4.0), ("Y", "YY", 2011, "s", 9.0),
]
INDICATOR_SCHEMA = "country string, country_code string, year int, series string, value double"


def test_series_ending_in_different_years_make_two_rows(spark):
    df = spark.createDataFrame(INDICATORS, INDICATOR_SCHEMA)
    wide = trust.latest_indicators(df, {"g": "gini", "s": "ratio"}, {}, 2013, {})
    assert rows(wide) == [("XX", "X", 2010, 1.0, None), ("XX", "X", 2012, None, 2.0), ("YY", "Y", 2012, 3.0, 4.0)]
    one = trust.latest_indicators(df, {"g": "gini", "s": "ratio"}, {}, 2013, {}, collapse_year=True)
    assert rows(one.select("country", "gini", "ratio", "year")) == [("X", 1.0, 2.0, 2012), ("Y", 3.0, 4.0, 2012)]


def test_nearest_year_takes_the_later_of_two_and_drops_the_year(spark):
    df = spark.createDataFrame(
        [("X", "XX", 1995, "gdp", 1.0), ("X", "XX", 1997, "gdp", 2.0), ("X", "XX", 1996, "gini", 3.0),
         ("Y", "YY", 1996, "gdp", 5.0), ("X", "XX", 1996, "other", 9.0)],
        INDICATOR_SCHEMA,
    )
    near = trust.nearest_indicators(df, {"gdp": "gdp-pc-ppp", "gini": "gini"}, [1995, 1996, 1997], 1996)
    assert near.columns == ["country", "country_code", "gdp-pc-ppp", "gini"]
    assert rows(near) == [("X", "XX", 2.0, 3.0)]


def test_clashing_columns_get_suffixes(spark):
    a = spark.createDataFrame([("X", 2000, 1)], "country string, year int, p int")
    b = spark.createDataFrame([("X", 2010, 2)], "country string, year int, q int")
    assert joins.inner_pick(a, b, "country").columns == ["country", "year_x", "p", "year_y", "q"]


def test_source_priority_is_a_list_not_a_sort(spark):
    df = spark.createDataFrame(
        [("X", "EVS2", 1990), ("X", "WVS3", 1995), ("Y", "EVS2", 1990), ("Y", "WVS2", 1991),
         ("Z", "WVS7", 2018)],
        "country string, source string, year int",
    )
    assert rows(trust.ranked_trust(df, trust.SOURCE_RANK)) == [("X", "WVS3", 1995), ("Y", "WVS2", 1991)]
    assert rows(trust.ranked_trust(df, ["EVS2", "WVS3"])) == [("X", "EVS2", 1990), ("Y", "EVS2", 1990)]


def test_unmatched_values_become_missing_or_stay(spark):
    df = spark.createDataFrame([("Korea",), ("Peru",), (None,)], "c string")
    mapped = df.select("c", recode.recode(F.col("c"), {"Korea": "South Korea"}).alias("n"),
                       recode.harmonise(F.col("c"), recode.INEQUALITY_NAMES).alias("h"))
    assert rows(mapped) == [(None, None, None), ("Korea", "South Korea", "South Korea"), ("Peru", None, "Peru")]


def test_alias_direction_depends_on_the_source(spark):
    assert value(spark, recode.harmonise(F.lit("Turkey"), recode.TRUST_NAMES)) == "Türkiye"
    assert value(spark, recode.harmonise(F.lit("Turkiye"), recode.INDICATOR_NAMES)) == "Turkey"
    assert value(spark, recode.harmonise(F.lit("Türkiye"), recode.CLASS_NAMES)) == "Turkey"
    assert value(spark, recode.harmonise(F.lit("Turkiye"), recode.CLASS_NAMES)) == "Turkiye"


def test_aliases_are_idempotent(spark):
    for names in (recode.TERRITORIES, recode.INEQUALITY_NAMES, recode.INDICATOR_NAMES, recode.CLASS_NAMES,
                  recode.TRUST_NAMES, recode.TERRITORY_CODES):
        assert not set(names) & set(names.values())


def test_no_filter_is_not_an_empty_filter(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert linked.option_keys(df, "v", "k", []) is None
    assert linked.apply(df, "k", linked.intersect({"v": None})).count() == 2
    nothing = linked.slider_keys(df, "k", F.col("v"), 10, 20)
    assert linked.apply(df, "k", linked.intersect({"v": None, "w": nothing})).count() == 0


def test_full_range_keeps_what_is_not_a_number(spark):
    df = spark.createDataFrame([("1",), ("5",), ("x",), (None,), ("NaN",)], "v string")
    kept = lambda c: rows(df.where(predicates.all_of([c])))
    assert len(kept(predicates.in_range(F.col("v"), 1, 5, domain=(1, 5), text=True))) == 5
    assert kept(predicates.in_range(F.col("v"), 1, 4, domain=(1, 5), text=True)) == [("1",)]
    assert kept(predicates.in_range(F.col("v"), 2, 5, domain=(1, 5), text=True)) == [("5",)]


def test_missing_flag_reads_na(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert df.where(predicates.flag_in(F.col("f"), ["na"])).count() == 1
    assert df.where(predicates.flag_in(F.col("f"), ["na", "true"])).count() == 2
    assert predicates.flag_in(F.col("f"), []) is None


def test_manifest_lines_in_level_order(spark):
    countries = spark.createDataFrame(
        [("GBR", "Great Britain", 826), ("ALB", "Albania", 8), ("AZE", "Azerbaijan", 31), ("X&Y", "A & <B>", 900)],
        "code string, name string, ord int",
    )
    lines = [r.line for r in manifest(countries, "EVS2017/evs2017", "/files/").orderBy("ord").collect()]
    item = '<li><a class="dropdown-item" href="/files/EVS2017/evs2017_%s.sav">%s</a></li>'
    assert lines == [
        "<!-- generated from EVS2017/evs2017.sav -->",
        item % ("ALB", "Albania"),
        item % ("AZE", "Azerbaijan"),
        "<!-- " + item % ("GBR", "Great Britain") + " -->",
        item % ("X&Y", "A &amp; &lt;B&gt;"),
    ]
    assert manifest(countries.where("ord > 1000"), "EVS2017/evs2017", "/files/").count() == 0


def test_two_values_for_one_cell_are_an_error(spark):
    df = spark.createDataFrame([("X", "g", 1.0), ("X", "g", 2.0)], "c string, s string, v double")
    with pytest.raises(Exception, match="more than one value for g"):
        reshape.widen(df, ["c"], "s", "v", {"g": "g"}).collect()


def test_widen_then_lengthen_is_the_identity(spark):
    df = spark.createDataFrame([("X", "g", 1.0), ("X", "s", 2.0), ("Y", "s", 3.0)], "c string, s string, v double")
    wide = reshape.widen(df, ["c"], "s", "v", {"g": "g", "s": "s"})
    assert rows(reshape.lengthen(wide, ["c"], ["g", "s"], "s", "v")) == rows(df)


def test_coded_missing_only_where_missing(spark):
    df = spark.createDataFrame([(1, None), (2, None), (1, 5.0)], "id int, v double")
    coded = df.select(recode.plant_missing(F.col("v"), [(F.col("id") == 1, 77.0)]))
    assert [r[0] for r in coded.collect()] == [77.0, None, 5.0]


def test_text_that_is_no_number_is_missing(spark):
    df = spark.createDataFrame([("1.5",), ("..",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(recode.to_number(F.col("v"))).collect()] == [1.5, None, None, None]


def test_trend_file_answers(spark):
    micro = spark.createDataFrame(
        [("WVS", 3, None, "Great Britain", 1998, 1), ("EVS", None, 2, "Northern Ireland", 1990, 2),
         ("WVS", 3, None, "Chile", 1996, None)],
        "survey string, wave int, wave_other int, country string, year int, answer int",
    )
    answers = trust.answers_of(micro, recode.TERRITORIES)
    assert rows(answers) == [("United Kingdom", "EVS2", 1990, 0), ("United Kingdom", "WVS3", 1998, 1)]
    shares = trust.trust_by_source(answers)
    assert shares.schema["n_valid"].metadata["label"] == "Total sample size"
    assert rows(shares) == [("United Kingdom", "EVS2", 1990, 0.0, 0, 1), ("United Kingdom", "WVS3", 1998, 100.0, 1, 1)]


def test_codes_are_values(spark):
    book = codebook.codebook(spark, {"v": {1: "one", 2: "two", 7: "never"}, "w": {"01": "first"}}, {"v": "Label"})
    df = spark.createDataFrame([(1.0, "01"), (2.0, "1"), (2.5, None), (None, None)], "v double, w string")
    named = codebook.decode(codebook.decode(df, book, "v", "label"), book, "w", "first")
    assert sorted(map(str, rows(named.select("label", "first")))) == sorted(
        map(str, [("one", "first"), ("two", None), (None, None), (None, None)])
    )
    left = codebook.drop_unused(book, df, ["v", "w"])
    assert sorted(r.label for r in left.collect()) == ["Label", "first", "one", "two"]
    assert sorted(rows(codebook.unlabelled(df, book, ["v", "w"]))) == [("v", "2.5", 1), ("w", "1", 1)]


def test_a_repeated_code_is_an_error(spark):
    twice = spark.createDataFrame([("v", "1", "one", 1), ("v", "1.0", "uno", 2)], "variable string, code string, label string, ord int")
    df = spark.createDataFrame([(1.0, "DE")], "v double, c string")
    with pytest.raises(Exception, match="lists a key twice"):
        codebook.decode(df, twice, "v", "label").collect()
    codes = spark.createDataFrame([("DE", "DEU"), ("DE", "GER")], "iso2 string, iso3 string")
    with pytest.raises(Exception, match="lists a key twice"):
        joins.crosswalk(df, codes, "c", "iso2", "iso3").collect()
    aliases = spark.createDataFrame([("s", "DE", "a"), ("s", "DE", "b")], "source string, from string, to string")
    with pytest.raises(Exception, match="lists a key twice"):
        recode.harmonise_by(df, "c", aliases, "s").collect()


def test_text_that_only_looks_like_a_number(spark):
    df = spark.createDataFrame([("1f",), ("1d",), ("5 kg",), (" 7 ",), ("-2.5e3",), (".5",), ("NaN",)], "v string")
    assert [r[0] for r in df.select(recode.to_number(F.col("v"))).collect()] == [None, None, None, 7.0, -2500.0, 0.5, None]


def test_numbers_as_a_browser_shows_them(spark):
    shown = {
        12345678.0: "12345678", 1e-4: "0.0001", 1.5: "1.5", 3.0: "3", 1.25e15: "1250000000000000", 1e21: "1e+21",
        1.5e-7: "1.5e-7", -2e10: "-20000000000", 0.0: "0", 1e-6: "0.000001", 123456789012.5: "123456789012.5",
    }
    df = spark.createDataFrame([(x,) for x in shown], "x double")
    assert {r.x: r.t for r in df.select("x", predicates.cell_text(df, "x").alias("t")).collect()} == shown


def test_a_range_of_whole_numbers_is_exact(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,)], "v bigint")
    assert rows(df.where(predicates.in_range(F.col("v"), 2**53 + 1, None))) == [(2**53 + 1,)]
