"""Inequality measures from individual incomes.

Equal incomes of a group are merged before the shuffle and ranked by running
totals, so neither a hot country nor a hot income ends up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wavebook.operators.aggregate import guarded_ratio
from wavebook.operators.ranking import running_totals


def _ranked(df: DataFrame, by: list[str], income: str) -> DataFrame:
    """(group, income, n, n_before, n_total)."""
    counts = (
        df.where(F.col(income).isNotNull()).groupBy(*by, income).agg(F.count("*").alias("n"))
    )
    return running_totals(counts, by, income, ["n"])


def gini(df: DataFrame, by: list[str], income: str) -> DataFrame:
    """(group, n, gini): sum((2i - n - 1) x) / (n sum x) over incomes in rising order."""
    x, n, before, total = (F.col(c) for c in (income, "n", "n_before", "n_total"))
    ranks = 2.0 * before + n + 1 - (total + 1)
    grouped = _ranked(df, by, income).groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(x * n * ranks).alias("_above"), F.sum(x * n).alias("_all")
    )
    return grouped.select(
        *by, "n", guarded_ratio(F.col("_above"), F.col("n") * F.col("_all")).alias("gini")
    )


def quintile_ratio(df: DataFrame, by: list[str], income: str) -> DataFrame:
    """(group, top_share, bottom_share, s80s20) from the five equal parts of a group.

    Parts differ by one person at most and the first parts get the extra one.
    """
    x, n, before, total = (F.col(c) for c in (income, "n", "n_before", "n_total"))
    bottom_size = F.floor(total / 5) + F.when(total % 5 > 0, 1).otherwise(0)
    top_start = F.when(total >= 5, total - F.floor(total / 5)).otherwise(total)
    after = before + n
    in_bottom = F.greatest(F.least(after, bottom_size) - before, F.lit(0))
    in_top = F.greatest(after - F.greatest(before, top_start), F.lit(0))
    sums = _ranked(df, by, income).groupBy(*by).agg(
        F.sum(x * in_top).alias("_top"), F.sum(x * in_bottom).alias("_bottom"), F.sum(x * n).alias("_all")
    )
    return sums.select(
        *by,
        guarded_ratio(F.col("_top"), F.col("_all")).alias("top_share"),
        guarded_ratio(F.col("_bottom"), F.col("_all")).alias("bottom_share"),
        guarded_ratio(F.col("_top"), F.col("_bottom")).alias("s80s20"),
    )


def correlation(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"),
                               F.corr(x, y).alias("corr"))
