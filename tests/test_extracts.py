import pytest
from pyspark.sql import functions as F

from wavebook.operators import columns
from wavebook.plans import country_files, extracts, macro


def test_indicator_extract(spark):
    raw = spark.createDataFrame(
        [("2019", "YR2019", "Turkiye", "TUR", "100.5", "8", "75", "..", "5", ""),
         ("2019", "YR2019", "Korea, Rep.", "KOR", "200", "5", "..", "40", "8", "5.0")],
        "`Time` string, `Time Code` string, `Country Name` string, `Country Code` string, `GDP [a]` string,"
        "`Pop [b]` string, `Urban [c]` string, `Top [d]` string, `Bottom [e]` string, `Ratio [f]` string",
    )
    table = macro.extract_table(raw)
    assert table.columns == list(macro.EXTRACT_NAMES.values())
    assert [tuple(r) for r in table.orderBy("country").collect()] == [
        ("South Korea", 200.0, 5.0, None, 40.0, 8.0, 5.0), ("Turkey", 100.5, 8.0, 75.0, None, 5.0, None),
    ]
    assert table.schema["s80s20"].metadata["label"].startswith("Ratio of")
    classes = spark.createDataFrame([(f"C{i}", "x", f"R{i % 3}") for i in range(230)] + [("Türkiye", "x", "ECA"), ("World", None, None)],
                                    "Economy string, Code string, Region string")
    top = macro.class_table(classes, F.col("Code").isNotNull())
    assert top.count() == 231 and top.columns == ["country", "Region"]
    shares = spark.createDataFrame([("Turkey", "TR", 12.5), ("Nowhere", "NN", 1.0)], "country string, cntry_AN string, trust_pct double")
    got = macro.merged(shares, table, top)
    assert {"country_code", "GDP_pc", "inequality_s80s20", "Region"} <= set(got.columns)
    rows = {r.country: (r.GDP_pc, r.Region) for r in got.collect()}
    assert rows == {"Turkey": (100.5, "ECA"), "Nowhere": (None, None)}
    assert got.schema["pop_n"].metadata["label"] == "Population size"


LONG = "country string, country_code string, year int, series string, value double"


def test_income_shares_around_2000(spark):
    high, low = macro.SHARE_SERIES
    df = spark.createDataFrame(
        [("Spain", "ESP", 1999, high, 40.0), ("Spain", "ESP", 2000, high, 42.0), ("Spain", "ESP", 2001, low, 8.2),
         ("Spain", "ESP", 1998, low, 1.0), ("Italy", "ITA", 2000, high, 40.0), ("Peru", "PER", 2000, high, 50.0),
         ("Norway", "NOR", 2000, "Gini index", 25.0)],
        LONG,
    )
    got = {r.country: (r.h20_m, r.l20_m, r.s80s20) for r in macro.share_ratio(df).collect()}
    assert got == {"Spain": (41.0, 8.2, pytest.approx(5.0)), "Italy": (40.0, None, None)}
    assert macro.share_ratio(df, countries=None).count() == 3


def test_gdp_and_gini(spark):
    gdp, gini = macro.GDP_SERIES
    df = spark.createDataFrame(
        [("Spain", "ESP", 1995, gdp, 1.0), ("Spain", "ESP", 1996, gdp, 2.0), ("Spain", "ESP", 1995, gini, 3.0),
         ("Italy", "ITA", 1996, gdp, 9.0)], LONG)
    got = macro.gdp_and_gini(df)
    assert [r.asDict() for r in got.collect()] == [
        {"country": "Spain", "country_code": "ESP", "gdp-pc-ppp": 2.0, "gini": 3.0}]


def test_teaching_samples(spark):
    names = list(extracts.SAMPLE_CODES.values())
    df = spark.createDataFrame(
        [(71215, *[None] * 12), (80670, *["3"] * 2, None, "11", None, *["3"] * 4, None, *["3"] * 2), (1, *["3"] * 12)],
        "idno bigint, " + ", ".join(f"{n} string" for n in names),
    )
    assert extracts.one_country(df, "idno = 1").count() == 1
    plain = {r.idno: r for r in extracts.teaching_sample(df).collect()}
    assert set(plain) == {71215, 80670} and plain[80670].ppltrst == 10.0
    coded = extracts.questionnaire_sample(df)
    assert coded.columns == ["idno", *extracts.SAMPLE_CODES]
    rows = {r.idno: r for r in coded.collect()}
    assert rows[71215].A3 == 7777.0 and rows[71215].A5 is None
    assert (rows[80670].A3, rows[80670].A5, rows[80670].C12, rows[80670].A4) == (8888.0, 88.0, 77.0, 10.0)


def test_model_sample(spark):
    names = [*extracts.MODEL_FIRST, *extracts.MODEL_COLUMNS, "brncntr", "reform_years"]
    base = {n: 1 for n in names} | {"agea": 25}
    people = [base, base | {"agea": 81}, base | {"brncntr": 2}, base | {"reform_years": -8}, base | {"female": None},
              base | {"eduyrs25": None}]
    df = spark.createDataFrame([tuple(p[n] for n in names) for p in people], ", ".join(f"{n} int" for n in names))
    got = extracts.reform_sample(df)
    assert got.count() == 2 and got.columns == [*extracts.MODEL_FIRST, *extracts.MODEL_COLUMNS]
    assert got.schema["female"].metadata["labels"] == ["Male", "Female"]
    assert got.schema["female"].metadata["label"] == "Sex"


def test_column_lists(spark):
    names = ["COUNTRY", "YEAR", *[f"V11_{c}" for c in ("A", "B", "TR")], *[f"V12{c}" for c in "ABCJ"]]
    df = spark.range(1).select(*[F.lit(1).alias(n) for n in names])
    got = columns.pick(df, "COUNTRY", columns.Span("V12A", "V12J"), columns.Span("V11_A", "V11_TR"))
    assert got.columns == ["COUNTRY", "V12A", "V12B", "V12C", "V12J", "V11_A", "V11_B", "V11_TR"]
    assert len(extracts.ESS_COLUMNS) == len(set(extracts.ESS_COLUMNS)) == 34


def test_numbered_questions_of_the_value_surveys(spark):
    country = ["country", "country_iso2", "country_iso3"]
    wvs = spark.range(1).select(*[F.lit(i).alias(f"Q{i}") for i in range(1, 291)], *[F.lit("x").alias(c) for c in country])
    got = country_files.world_values(wvs)
    assert got.columns[:9] == [*country, "Q6", "Q165", "Q171", "Q172", "Q173", "Q289"] and "Q131" in got.columns and "Q200" not in got.columns
    evs = [f"v{i}" for i in range(1, 282)] + ["v239_r", "v243_r", "v261_ppp", "v261_r"]
    got = country_files.european_values(spark.range(1).select(*[F.lit(1).alias(c) for c in [*evs, *country]]))
    assert got.columns[:6] == [*country, "v6", "v9", "v51"] and got.columns[-4:] == ["v260", "v261", "v261_ppp", "v261_r"]


def test_columns_of_the_social_surveys(spark):
    ess = spark.range(1).select(*[F.lit(1).alias(c) for c in reversed(extracts.ESS_COLUMNS)], F.lit(2).alias("other"))
    assert extracts.social_survey(ess).columns == [*extracts.ESS_COLUMNS[-3:], *extracts.ESS_COLUMNS[:-3]]
    letters = {"V31": "ABCDE", "V21": "ABCU", "V12": "ABJ", "V51": "ABCD", "V17": "ABJ", "V58": "ABM"}
    names = ["COUNTRY", "YEAR", "V7", "V8", "V33", "V55A", "V55B", "V55D", "V55E", "V23", "V28", "V40", "V56", "V57", "V24",
             "V24_PPP", "V26", "V27", "V22", "V36", "V46", "V13", "V14", "V15", "V11_A", "V11_TR", "V50", "V49", "V52", "V61"]
    names += [f"{v}{c}" for v, cs in letters.items() for c in cs]
    got = extracts.euromodule(spark.range(1).select(*[F.lit(1).alias(c) for c in [*names, "V99"]]))
    assert sorted(got.columns) == sorted(names) and got.columns[:4] == ["COUNTRY", "YEAR", "V7", "V8"]
