"""Checks of shape and keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wavebook.operators.joins import sized_join
from wavebook.session import materialise


def fingerprint(columns: list[str]) -> list[Column]:
    """128 bits of a row in two columns, ``_a`` and ``_b``.

    Spark's hash passes over nulls, so each value comes with whether it is missing:
    (null, 1) and (1, null) differ.
    """
    parts = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return [F.xxhash64(*parts).alias("_a"), F.xxhash64(F.lit("second"), *parts[::-1]).alias("_b")]


def audit(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """(table_name, n_rows, n_distinct, n_keys, key_is_unique).

    What is shuffled for every row is its key and a fingerprint of 16 bytes. A fingerprint
    that is there once is a distinct row; the rows of the others, copies or collisions, are
    looked at whole, so the numbers are exact. Copies and hot keys are merged before each
    shuffle and no distinct count is expanded. A table is read a second time only if it has
    repeated fingerprints.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    key = [f"c{df.columns.index(k)}" for k in keys]
    printed = plain.select("*", *fingerprint(plain.columns))
    groups = materialise(printed.groupBy("_a", "_b", *key).agg(F.count("*").alias("_n")))
    counted = groups.groupBy(*key).agg(F.sum("_n").alias("_n"), F.count_if(F.col("_n") == 1).alias("_d"))
    totals = counted.agg(F.sum("_n").alias("_n"), F.sum("_d").alias("_d"), F.count("*").alias("_k"))
    several = groups.where("_n > 1").select("_a", "_b", *key)
    if not several.isEmpty():
        whole = sized_join(printed, several, ["_a", "_b", *key], "left_semi")
        rows = whole.groupBy(*plain.columns).agg(F.lit(1).alias("_one"))
        totals = totals.unionAll(rows.agg(F.lit(0), F.count("*"), F.lit(0)))
    return totals.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("_d"), F.lit(0)).alias("n_distinct"),
        F.sum("_k").alias("n_keys"),
    ).select(
        F.lit(name).alias("table_name"),
        "n_rows",
        "n_distinct",
        "n_keys",
        (F.col("n_rows") == F.col("n_keys")).alias("key_is_unique"),
    )


def contract(tables: dict[str, tuple[DataFrame, int | None, int]]) -> DataFrame:
    """(table_name, n_rows, n_cols, as_expected) for ``{name: (frame, rows, cols)}``.

    An expected row count of ``None`` checks the columns only.
    """

    def check(name, frame, rows, cols):
        width = len(frame.columns)
        count = F.count("*")
        fits = F.lit(width == cols) & (F.lit(True) if rows is None else count == rows)
        return frame.agg(
            F.lit(name).alias("table_name"),
            count.alias("n_rows"),
            F.lit(width).alias("n_cols"),
            fits.alias("as_expected"),
        )

    return reduce(DataFrame.unionAll, [check(n, *spec) for n, spec in tables.items()])
