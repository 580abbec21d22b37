"""Shares, means, frequencies and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wavebook.functions.formats import round_half_even
from wavebook.operators.joins import sized_join
from wavebook.operators.ranking import running_totals


def _share(total: Column, valid: Column) -> Column:
    return round_half_even(total / F.when(valid > 0, valid) * 100, 2)


def answer_share(
    df: DataFrame, by: list[str], answer: str, carry: list[str] = (), weight: str | None = None
) -> DataFrame:
    """Percent answering 1 per group, number of yes answers, number of valid answers.

    ``carry`` columns are kept: the group's figures are repeated for each of
    their values. Rows are counted per (group, carry) first, with map-side
    merging, so the window that adds the counts up sees one row per carried
    value however large the group is. ``weight`` is a column saying for how
    many respondents a row stands.
    """
    times = F.col(weight) if weight else F.lit(1)
    value = F.col(answer)
    counts = df.groupBy(*by, *carry).agg(
        F.sum(value * times).alias("_sum"),
        F.sum(F.when(value == 1, times).otherwise(0)).alias("_yes"),
        F.sum(F.when(value.isNotNull(), times).otherwise(0)).alias("_valid"),
    )
    group = Window.partitionBy(*by)
    whole = {c: F.sum(c).over(group) if carry else F.col(c) for c in ("_sum", "_yes", "_valid")}
    return counts.select(
        *by,
        *carry,
        _share(whole["_sum"], whole["_valid"]).alias("trust_pct"),
        whole["_yes"].cast("long").alias("n_trusts"),
        whole["_valid"].cast("long").alias("n_valid"),
    )


def share_on_rows(df: DataFrame, by: list[str], shares: DataFrame) -> DataFrame:
    """The group's percentage on every row, without collapsing.

    ``shares`` is what ``answer_share`` gives for the groups, from rows or from
    counts. A window would sort all rows of a group in one task, so the figures are
    joined to the rows, which are read once.
    """
    return sized_join(df, shares.select(*by, "trust_pct").distinct(), by, "left")


def period_means(df: DataFrame, by: list[str], series: str, value: str, names: dict[str, str]) -> DataFrame:
    """Mean of each series per group, one column per series, missing values ignored."""
    return df.groupBy(*by).agg(
        *[F.avg(F.when(F.col(series) == old, F.col(value))).alias(new) for old, new in names.items()]
    )


def guarded_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, missing if either is missing or the bottom is zero."""
    return F.try_divide(top, bottom)


def frequency(df: DataFrame, column: str) -> DataFrame:
    """(value, ord, n, raw_pct, valid_pct, cum_pct) with a row for missing values.

    Only the merged counts are ranked, by the running-total operator, so a
    column with very many values does not end up in one task.
    """
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranked = running_totals(
        counts.withColumn("_valid", F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)),
        [],
        "value",
        ["n", "_valid"],
    )
    share = lambda part, all_: round_half_even(part * 100.0 / F.when(all_ > 0, all_), 2)
    valid = F.col("value").isNotNull()
    return ranked.select(
        "value",
        "n",
        share(F.col("n"), F.col("n_total")).alias("raw_pct"),
        F.when(valid, share(F.col("n"), F.col("_valid_total"))).alias("valid_pct"),
        F.when(valid, share(F.col("_valid_before") + F.col("n"), F.col("_valid_total"))).alias("cum_pct"),
    )


def levels_in_use(df: DataFrame, code: Column, label: Column, order: Column) -> DataFrame:
    """(code, label, ord) of the levels that occur, with their declared order."""
    return df.select(code.alias("code"), label.alias("label"), order.alias("ord")).distinct()
