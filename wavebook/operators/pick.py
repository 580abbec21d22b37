"""One row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in a declared total order.

    Filtering a row number to 1 lets Spark keep one row per key and task
    before the shuffle, so a hot key does not travel.
    """
    if not order:
        raise ValueError("picking one row per key needs a total order")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def latest_per_key(df: DataFrame, keys: list[str], year: str, tiebreak: list[Column]) -> DataFrame:
    """The row with the highest year; ``tiebreak`` decides between rows of one year."""
    return first_per_key(df, keys, [F.col(year).desc(), *tiebreak])


def by_priority(
    df: DataFrame, keys: list[str], source: str, ranked: list[str], tiebreak: list[Column]
) -> DataFrame:
    """The row from the first source of a ranked list; other sources are left out."""
    place = F.array_position(F.array(*[F.lit(name) for name in ranked]), F.col(source))
    return first_per_key(df.where(F.col(source).isin(ranked)), keys, [place, *tiebreak])


def nearest_per_key(
    df: DataFrame, keys: list[str], year: str, target: int, tiebreak: list[Column] = ()
) -> DataFrame:
    """The row nearest to a year; of two equally near years the later one."""
    distance = F.abs(F.col(year) - target)
    return first_per_key(df, keys, [distance, F.col(year).desc(), *tiebreak])
