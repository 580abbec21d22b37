"""Published figures."""

import pytest
from pyspark.sql import functions as F

from wavebook.operators import aggregate, columns, inequality
from wavebook.sources import exports

# Incomes of two populations of ten.
POPULATIONS = {
    "A": [8000, 10000, 9000, 10000, 10000, 8000, 7000, 8000, 390000, 540000],
    "B": [80000, 100000, 90000, 120000, 140000, 70000, 70000, 90000, 120000, 120000],
}

# Quintile ratio and trust in 23 countries.
COUNTRIES = [
    ("Australia", 7, 39.900001525878906), ("Austria", 4.824999809265137, 33.900001525878906),
    ("Belgium", 4.599999904632568, 30.700000762939453), ("Canada", 5.625, 38.79999923706055),
    ("Denmark", 4.300000190734863, 66.5), ("Finland", 3.7249999046325684, 58),
    ("France", 5.599999904632568, 22.200000762939453), ("Germany", 5.200000286102295, 34.79999923706055),
    ("Greece", 6.199999809265137, 23.700000762939453), ("Ireland", 6.050000190734863, 35.20000076293945),
    ("Israel", 6.775000095367432, 23.5), ("Italy", 6.650000095367432, 32.599998474121094),
    ("Japan", 3.4000000953674316, 43.099998474121094), ("Netherlands", 5.300000190734863, 59.79999923706055),
    ("New Zealand", 6.800000190734863, 49.099998474121094), ("Norway", 3.8500001430511475, 65.30000305175781),
    ("Portugal", 8, 10), ("Singapore", 9.699999809265137, 16.899999618530273),
    ("Spain", 5.550000190734863, 36.20000076293945), ("Sweden", 3.950000047683716, 66.30000305175781),
    ("Switzerland", 5.725000381469727, 41), ("UK", 7.174999713897705, 29.799999237060547),
    ("USA", 8.549999237060547, 35.79999923706055),
]


@pytest.fixture
def people(spark):
    rows = [(c, float(x)) for c, incomes in POPULATIONS.items() for x in incomes]
    return spark.createDataFrame(rows, "country string, income double")


def test_gini(people):
    values = {r.country: (r.n, r.gini) for r in inequality.gini(people, ["country"], "income").collect()}
    assert values["A"] == (10, pytest.approx(0.7488))
    assert values["B"] == (10, pytest.approx(0.1280))


def test_quintile_ratio(people):
    values = {r.country: r for r in inequality.quintile_ratio(people, ["country"], "income").collect()}
    assert values["A"].s80s20 == pytest.approx(62.0)
    assert values["B"].s80s20 == pytest.approx(1.857142857)
    assert values["B"].top_share == pytest.approx(0.26)


def test_ratio_of_published_shares(spark):
    ratio = spark.range(1).select(F.round(aggregate.guarded_ratio(F.lit(40.0), F.lit(7.2)), 1)).first()[0]
    assert ratio == 5.6


def test_correlation_of_ratio_and_trust(spark):
    df = spark.createDataFrame([(c, float(s), float(t)) for c, s, t in COUNTRIES], "c string, s double, t double")
    row = inequality.correlation(df, [], "s", "t").first()
    assert row.n == 23
    assert row["corr"] == pytest.approx(-0.664185555, abs=1e-9)


# The countries of three published lists of country files, in their order.
ESS10 = [
    ("BEL", "Belgium"), ("BGR", "Bulgaria"), ("CHE", "Switzerland"), ("CZE", "Czechia"), ("EST", "Estonia"),
    ("FIN", "Finland"), ("FRA", "France"), ("GBR", "United Kingdom"), ("GRC", "Greece"), ("HRV", "Croatia"),
    ("HUN", "Hungary"), ("IRL", "Ireland"), ("ISL", "Iceland"), ("ITA", "Italy"), ("LTU", "Lithuania"),
    ("MNE", "Montenegro"), ("MKD", "North Macedonia"), ("NLD", "Netherlands"), ("NOR", "Norway"),
    ("PRT", "Portugal"), ("SVN", "Slovenia"), ("SVK", "Slovakia"),
]
EVS2017 = [
    ("ALB", "Albania"), ("AZE", "Azerbaijan"), ("AUT", "Austria"), ("ARM", "Armenia"),
    ("BIH", "Bosnia and Herzegovina"), ("BGR", "Bulgaria"), ("BLR", "Belarus"), ("HRV", "Croatia"),
    ("CZE", "Czechia"), ("DNK", "Denmark"), ("EST", "Estonia"), ("FIN", "Finland"), ("FRA", "France"),
    ("GEO", "Georgia"), ("DEU", "Germany"), ("HUN", "Hungary"), ("ISL", "Iceland"), ("ITA", "Italy"),
    ("LVA", "Latvia"), ("LTU", "Lithuania"), ("MNE", "Montenegro"), ("NLD", "Netherlands"), ("NOR", "Norway"),
    ("POL", "Poland"), ("PRT", "Portugal"), ("ROU", "Romania"), ("RUS", "Russia"), ("SRB", "Serbia"),
    ("SVK", "Slovakia"), ("SVN", "Slovenia"), ("ESP", "Spain"), ("SWE", "Sweden"), ("CHE", "Switzerland"),
    ("UKR", "Ukraine"), ("MKD", "North Macedonia"), ("GBR", "Great Britain"),
]
WVS7 = [
    ("AND", "Andorra"), ("ARG", "Argentina"), ("ARM", "Armenia"), ("AUS", "Australia"), ("BGD", "Bangladesh"),
    ("BOL", "Bolivia"), ("BRA", "Brazil"), ("CAN", "Canada"), ("CHL", "Chile"), ("CHN", "China"),
    ("COL", "Colombia"), ("CYP", "Cyprus"), ("CZE", "Czechia"), ("DEU", "Germany"), ("ECU", "Ecuador"),
    ("EGY", "Egypt"), ("ETH", "Ethiopia"), ("GBR", "United Kingdom"), ("GRC", "Greece"), ("GTM", "Guatemala"),
    ("HKG", "Hong Kong SAR"), ("IDN", "Indonesia"), ("IND", "India"), ("IRN", "Iran"), ("IRQ", "Iraq"),
    ("JOR", "Jordan"), ("JPN", "Japan"), ("KAZ", "Kazakhstan"), ("KEN", "Kenya"), ("KGZ", "Kyrgyzstan"),
    ("KOR", "South Korea"), ("LBN", "Lebanon"), ("LBY", "Libya"), ("MAC", "Macau SAR"), ("MAR", "Morocco"),
    ("MDV", "Maldives"), ("MEX", "Mexico"), ("MMR", "Myanmar"), ("MNG", "Mongolia"), ("MYS", "Malaysia"),
    ("NGA", "Nigeria"), ("NIC", "Nicaragua"), ("NLD", "Netherlands"), ("NZL", "New Zealand"),
    ("PAK", "Pakistan"), ("PER", "Peru"), ("PHL", "Philippines"), ("PRI", "Puerto Rico"), ("ROU", "Romania"),
    ("RUS", "Russia"), ("SGP", "Singapore"), ("SRB", "Serbia"), ("SVK", "Slovakia"), ("THA", "Thailand"),
    ("TJK", "Tajikistan"), ("TUN", "Tunisia"), ("TUR", "Turkey"), ("TWN", "Taiwan ROC"), ("UKR", "Ukraine"),
    ("URY", "Uruguay"), ("USA", "United States"), ("UZB", "Uzbekistan"), ("VEN", "Venezuela"),
    ("VNM", "Vietnam"), ("ZWE", "Zimbabwe"),
]


@pytest.mark.parametrize("dataset, countries", [("ESS10/ess10", ESS10), ("EVS2017/evs2017", EVS2017), ("WVS7/wvs7", WVS7)])
def test_published_lists_of_links(spark, dataset, countries):
    """The header, one item per country in the order of the survey, the United Kingdom hidden."""
    rows = [(code, name, i) for i, (code, name) in enumerate(countries)]
    lines = exports.manifest(spark.createDataFrame(rows, "code string, name string, ord int"), dataset, "/Data/assignment_data/")
    got = [r.line for r in lines.orderBy("ord").collect()]
    want = [f"<!-- generated from {dataset}.sav -->"]
    for code, name in countries:
        item = f'<li><a class="dropdown-item" href="/Data/assignment_data/{dataset}_{code}.sav">{name}</a></li>'
        want.append(f"<!-- {item} -->" if code == "GBR" else item)
    assert got == want


def test_pick_and_rename_of_the_published_table(spark):
    """Columns 1, 2 under a new name, 3, 4, 5, 10 and 11 of a sheet with 23 countries."""
    names = ["Country", "Income inequality", "Trust", "Life expectancy", "Infant mortality", *[f"c{i}" for i in range(6, 10)],
             "Homicides", "Imprisonment (log)", "c12"]
    df = spark.createDataFrame([(c, float(s), float(t), *[float(i) for i in range(4, 13)]) for c, s, t in COUNTRIES], names)
    picked = columns.rename_at(columns.pick(df, *range(1, 6), 10, 11), {2: "S80S20"})
    assert picked.columns == ["Country", "S80S20", "Trust", "Life expectancy", "Infant mortality", "Homicides", "Imprisonment (log)"]
    rows = {r.Country: tuple(r)[1:] for r in picked.collect()}
    assert len(rows) == 23 and rows["Japan"] == (3.4000000953674316, 43.099998474121094, 4.0, 5.0, 10.0, 11.0)
