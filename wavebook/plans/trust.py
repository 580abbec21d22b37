"""Social trust by country against inequality indicators.

Inputs are frames, so the same plan runs on survey files and on stand-ins:

answers      country, source, year, trust (1 yes, 0 no, missing), times
indicators   country, country_code, year, series, value
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wavebook.functions.text import paste
from wavebook.operators.aggregate import answer_share
from wavebook.operators.codebook import set_variable_labels
from wavebook.operators.joins import inner_pick
from wavebook.operators.pick import by_priority, first_per_key, latest_per_key, nearest_per_key
from wavebook.operators.predicates import until
from wavebook.operators.recode import harmonise, recode, reverse_scale
from wavebook.operators.reshape import widen

# The codes of the trust question and the sources by rank.
TRUST_HIGHEST = 2
SOURCE_RANK = ["WVS3", "WVS2", "EVS2"]
LABELS = {
    "trust_pct": "% people who agree that “most people can be trusted”",
    "n_trusts": "Number of people who agree that “most people can be trusted”",
    "n_valid": "Total sample size",
}


def answers_of(microdata: DataFrame, territories: dict[str, str]) -> DataFrame:
    """Answers from trend-file columns survey, wave, wave_other, country, year, answer."""
    return microdata.where("answer is not null").select(
        harmonise(F.col("country"), territories).alias("country"),
        paste(F.col("survey"), F.coalesce("wave", "wave_other")).alias("source"),
        F.col("year").cast("int").alias("year"),
        reverse_scale(F.col("answer"), TRUST_HIGHEST).alias("trust"),
    )


def trust_by_source(answers: DataFrame, weight: str | None = None) -> DataFrame:
    """(country, source, year, trust_pct, n_trusts, n_valid) with variable labels."""
    shares = answer_share(answers, ["country", "source"], "trust", ["year"], weight)
    return set_variable_labels(shares, **LABELS)


def latest_trust(shares: DataFrame, names: dict[str, str]) -> DataFrame:
    """The latest year per country; sources of one year in alphabetical order."""
    latest = latest_per_key(shares, ["country"], "year", [F.col("source")])
    return latest.withColumn("country", harmonise(F.col("country"), names))


def ranked_trust(shares: DataFrame, ranked: list[str]) -> DataFrame:
    """One row per country from the best source it has."""
    return by_priority(shares, ["country"], "source", ranked, [F.col("year").desc()])


def latest_indicators(
    indicators: DataFrame,
    series: dict[str, str],
    names: dict[str, str],
    limit: int,
    exceptions: dict[str, int],
    collapse_year: bool = False,
) -> DataFrame:
    """The latest value of each series up to a year, one column per series.

    The year is part of the row: a country whose series end in different years
    has one row for each, with gaps. ``collapse_year`` gives one row per country
    with the last of those years.
    """
    usable = indicators.where(
        F.col("value").isNotNull() & until(F.col("year"), F.col("country"), limit, exceptions)
    )
    latest = latest_per_key(
        usable, ["country", "series"], "year", [F.col("country_code"), F.col("value")]
    )
    ids = ["country_code", "country"]
    if collapse_year:
        wide = widen(latest, ids, "series", "value", series, [F.max("year").alias("year")])
    else:
        wide = widen(latest, [*ids, "year"], "series", "value", series)
    return wide.withColumn("country", harmonise(F.col("country"), names))


def nearest_indicators(
    indicators: DataFrame, series: dict[str, str], years: list[int], target: int
) -> DataFrame:
    """Per country the value of each series nearest to a year; complete rows only."""
    named = indicators.where(F.col("value").isNotNull() & F.col("year").isin(years)).withColumn(
        "series", recode(F.col("series"), series)
    )
    near = nearest_per_key(
        named.where("series is not null"), ["country", "series"], "year", target,
        [F.col("country_code"), F.col("value")],
    )
    wide = widen(
        near, ["country", "country_code"], "series", "value", {name: name for name in series.values()}
    )
    return wide.dropna("any")


def trust_inequality(trust: DataFrame, inequality: DataFrame, measures: list[str]) -> DataFrame:
    """Trust joined with inequality; both years are kept under their own names."""
    return inner_pick(inequality, trust, "country").select(
        "country",
        "trust_pct",
        *measures,
        F.col("source").alias("trust_source"),
        F.col("n_trusts").alias("trust_n_agrees"),
        F.col("n_valid").alias("trust_n_total"),
        F.col("year_y").alias("trust_year"),
        F.col("year_x").alias("inequality_year"),
    )


def one_share_per_country(answers: DataFrame, keep: list[str], order: list, weight: str | None) -> DataFrame:
    """Percent per country, with the other columns of the country's first row."""
    shares = answer_share(answers, ["country"], "trust", keep, weight)
    return first_per_key(shares, ["country"], order)
