"""Recoding answers and harmonising names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wavebook.operators.joins import one_per_key

# Territories counted as one country.
TERRITORIES = {"Great Britain": "United Kingdom", "Northern Ireland": "United Kingdom"}
TERRITORY_CODES = {"NIR": "GBR"}

# Spellings by source, each brought to the spelling it is joined with.
TRUST_NAMES = {"Turkey": "Türkiye"}
INEQUALITY_NAMES = {
    "China (People’s Republic of)": "China",
    "Korea": "South Korea",
    "Slovak Republic": "Slovakia",
}
INDICATOR_NAMES = {
    "Russian Federation": "Russia",
    "Slovak Republic": "Slovakia",
    "Egypt, Arab Rep.": "Egypt",
    "Hong Kong SAR, China": "Hong Kong SAR",
    "Iran, Islamic Rep.": "Iran",
    "Kyrgyz Republic": "Kyrgyzstan",
    "Macao SAR, China": "Macau SAR",
    "Korea, Rep.": "South Korea",
    "Turkiye": "Turkey",
}
CLASS_NAMES = {**{k: v for k, v in INDICATOR_NAMES.items() if k != "Turkiye"}, "Türkiye": "Turkey"}


# A number as text, blanks around it allowed.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def recode(value: Column, rules: dict, default: Column | None = None) -> Column:
    """Replace values by a list of rules; a value without a rule becomes missing,
    or ``default`` where one is given."""
    chain = F.when(F.lit(False), F.lit(None))
    for old, new in rules.items():
        chain = chain.when(value == F.lit(old), F.lit(new))
    return chain if default is None else chain.otherwise(default)


def harmonise(value: Column, names: dict[str, str]) -> Column:
    """Replace known spellings and keep all others."""
    return recode(value, names, value)


def harmonise_by(df: DataFrame, column: str, aliases: DataFrame, source: str) -> DataFrame:
    """The same with an alias table (source, from, to), for lists kept as data.

    A spelling listed twice for a source is an error.
    """
    pairs = aliases.where((F.col("source") == source) & F.col("from").isNotNull()).select(
        F.col("from").alias("_from"), F.col("to").alias("_to")
    )
    pairs = one_per_key(pairs, ["_from"], "the alias table")
    return (
        df.join(pairs, F.col(column) == F.col("_from"), "left")
        .withColumn(column, F.coalesce("_to", column))
        .drop("_from", "_to")
    )


def first_match(rules: list[tuple[Column, object]], default: Column) -> Column:
    """The value of the first condition that holds."""
    chain = F.when(F.lit(False), F.lit(None))
    for condition, value in rules:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def plant_missing(value: Column, rules: list[tuple[Column, float]]) -> Column:
    """Write a missing-value code where a condition holds and the value is missing."""
    return first_match([(condition & value.isNull(), code) for condition, code in rules], value)


def reverse_scale(value: Column, highest: int) -> Column:
    """Shift a scale to start at 0 and turn it round.

    The highest code comes from the codebook, never from the rows of a group: a
    group with a single answer would otherwise be shifted onto itself.
    """
    return F.lit(highest) - value


def to_number(value: Column) -> Column:
    """Text to number; text that is none becomes missing.

    The whole text must be a number: no unit (``5 kg``), no letter that marks a
    type in program code (``1f``).
    """
    text = value.cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))
