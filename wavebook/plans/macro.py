"""Country tables of macro indicators, and their merge with survey averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wavebook.operators import codebook, columns
from wavebook.operators.aggregate import guarded_ratio, period_means
from wavebook.operators.joins import left_merge
from wavebook.operators.recode import CLASS_NAMES, INDICATOR_NAMES, harmonise, to_number
from wavebook.plans.trust import nearest_indicators

# Positions and names of the indicator extract.
EXTRACT_POSITIONS = (3, *range(5, 11))
EXTRACT_NAMES = {
    1: "country", 2: "GDPpercap2", 3: "pop", 4: "urban_pop_pct", 5: "inc_top20", 6: "inc_bottom20",
    7: "s80s20",
}
EXTRACT_LABELS = {
    "GDPpercap2": "GDP per capita, PPP (constant 2017 international $)",
    "s80s20": "Ratio of the average income of the 20% richest to the 20% poorest",
}

# Names and labels of the merged table.
MERGED_NAMES = {
    "cntry_AN": "country_code", "GDPpercap2": "GDP_pc", "pop": "pop_n", "inc_top20": "income_top20",
    "inc_bottom20": "income_bottom20", "s80s20": "inequality_s80s20",
}
MERGED_LABELS = {
    "country": "Country name",
    "pop_n": "Population size",
    "urban_pop_pct": "% of population living in urban areas",
    "income_top20": "Share of population in the top 20% of the income distribution",
    "income_bottom20": "Share of population in the bottom 20% of the income distribution",
    "Region": "Geographical region (World Bank classification)",
}

# Indicator names and the years and countries they are used for.
SHARE_SERIES = {
    "Income share held by highest 20%": "h20_m",
    "Income share held by lowest 20%": "l20_m",
}
SHARE_YEARS = (1999, 2001)
SHARE_COUNTRIES = [
    "Australia", "Greece", "Portugal", "Austria", "Ireland", "Singapore", "Belgium", "Israel", "Spain",
    "Canada", "Italy", "Sweden", "Denmark", "Japan", "Switzerland", "Finland", "Netherlands",
    "United Kingdom", "France", "New Zealand", "United States", "Germany", "Norway",
]
GDP_SERIES = {
    "GDP per capita, PPP (current international $)": "gdp-pc-ppp",
    "Gini index": "gini",
}
GDP_YEARS = [1995, 1996]
GDP_TARGET = 1996


def extract_table(extract: DataFrame) -> DataFrame:
    """The indicator extract: chosen by position, cast, countries as the surveys spell them."""
    table = columns.rename_at(columns.pick(extract, *EXTRACT_POSITIONS), EXTRACT_NAMES)
    table = columns.across(table, table.columns[1:], to_number)
    table = table.withColumn("country", harmonise(F.col("country"), INDICATOR_NAMES))
    return codebook.set_variable_labels(table, **EXTRACT_LABELS)


def class_table(classes: DataFrame, listed: Column) -> DataFrame:
    """Country and region of the listed rows; a sheet's totals and notes are not ``listed``."""
    table = columns.pick(classes.where(listed).withColumnRenamed("Economy", "country"), 1, 3)
    return table.withColumn("country", harmonise(F.col("country"), CLASS_NAMES))


def merged(shares: DataFrame, extract: DataFrame, classes: DataFrame) -> DataFrame:
    """Survey averages with indicators and regions, under their final names and labels."""
    table = left_merge([shares, extract, classes], "country").withColumnsRenamed(MERGED_NAMES)
    labels = {name: label for name, label in MERGED_LABELS.items() if name in table.columns}
    return codebook.set_variable_labels(table, **labels)


def share_ratio(indicators: DataFrame, countries: list[str] | None = SHARE_COUNTRIES) -> DataFrame:
    """Mean income shares of the top and bottom fifth around 2000 and their ratio."""
    rows = indicators.where(
        F.col("value").isNotNull()
        & F.col("year").between(*SHARE_YEARS)
        & F.col("series").isin(list(SHARE_SERIES))
    )
    if countries is not None:
        rows = rows.where(F.col("country").isin(countries))
    means = period_means(rows, ["country", "country_code"], "series", "value", SHARE_SERIES)
    return means.withColumn("s80s20", guarded_ratio(F.col("h20_m"), F.col("l20_m")))


def gdp_and_gini(indicators: DataFrame) -> DataFrame:
    """GDP per head and Gini index nearest to 1996, for countries that have both."""
    return nearest_indicators(indicators, GDP_SERIES, GDP_YEARS, GDP_TARGET)
