"""Editing cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def patch_cells(
    df: DataFrame, key: str, edits: DataFrame, columns: list[str], read_only: list[str] = ()
) -> DataFrame:
    """Write the values of an edit list (row, col, value) into ``columns``.

    Values arrive as text and are cast to the column's type; text that cannot
    be cast is an error. So are a read-only column, an unknown column and two
    values for one cell.
    """
    refused = [c for c in columns if c in read_only or c == key or c not in df.columns]
    if refused:
        raise ValueError(f"not editable: {', '.join(refused)}")
    bad = F.raise_error(F.concat(F.lit("column is not editable: "), F.coalesce("col", F.lit("?"))))
    twice = F.raise_error(F.concat(F.lit("two values for one cell of row "), F.col("row").cast("string")))
    checked = edits.select(
        "row", F.when(F.col("col").isin(columns), F.col("col")).otherwise(bad).alias("col"), "value"
    )

    def cell(name):
        here = F.col("col") == name
        value = F.max(F.when(here, F.struct("value")))
        return F.when(F.count_if(here) > 1, twice.cast("struct<value:string>")).otherwise(value).alias(f"_{name}")

    by_row = checked.groupBy(F.col("row").alias("_row")).agg(*[cell(c) for c in columns])
    joined = df.join(by_row, F.col(key) == F.col("_row"), "left")

    def patched(name):
        edit = F.col(f"_{name}")
        new = edit["value"].cast(df.schema[name].dataType)
        return F.when(edit.isNotNull(), new).otherwise(F.col(name)).alias(name)

    return joined.select(*[patched(c) if c in columns else F.col(c) for c in df.columns])


def append_rows(df: DataFrame, rows: DataFrame, row_name: Column | None = None) -> DataFrame:
    """Rows of the same width, matched by position.

    Rows that are one value short get their ``row_name`` in front, where a table
    shows the names of its rows.
    """
    if len(rows.columns) == len(df.columns) - 1 and row_name is not None:
        rows = rows.select(row_name.alias("_name"), *rows.columns)
    if len(rows.columns) != len(df.columns):
        raise ValueError(f"new rows must have {len(df.columns)} columns, not {len(rows.columns)}")
    cast = [F.col(new).cast(f.dataType).alias(f.name) for new, f in zip(rows.columns, df.schema)]
    return df.unionAll(rows.select(*cast))
