"""Long to wide, and columnar arrays to rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def widen(
    df: DataFrame,
    ids: list[str],
    names: str,
    value: str,
    wanted: dict[str, str],
    also: list[Column] = (),
) -> DataFrame:
    """One row per ``ids``, one column per wanted name (``{"name": "column"}``).

    The names are given, so no job looks them up, and one aggregation with
    map-side merging does it all. Two values for one cell are an error.
    ``also`` are further aggregates of the same rows.
    """

    def cell(name: str, column: str) -> Column:
        here = F.col(names) == name
        clash = F.concat(F.lit(f"more than one value for {name} in "), F.to_json(F.struct(*ids)))
        return (
            F.when(F.count_if(here) > 1, F.raise_error(clash).cast(df.schema[value].dataType))
            .otherwise(F.max(F.when(here, F.col(value))))
            .alias(column)
        )

    return df.groupBy(*ids).agg(*[cell(name, column) for name, column in wanted.items()], *also)


def lengthen(df: DataFrame, ids: list[str], columns: list[str], names: str, value: str) -> DataFrame:
    """The reverse of ``widen``; empty cells give no row."""
    pairs = [F.struct(F.lit(c).alias(names), F.col(c).alias(value)) for c in columns]
    return df.select(*ids, F.inline(F.array(*pairs))).where(F.col(value).isNotNull())


def _same_size(arrays: list[Column]) -> Column:
    first = F.size(arrays[0])
    return reduce(lambda a, b: a & b, [F.size(a) == first for a in arrays[1:]], F.lit(True))


def arrays_to_rows(df: DataFrame, ids: list[str], arrays: list[str]) -> DataFrame:
    """Columnar arrays to one row per place; arrays of different length are an error.

    Each row is unfolded where it is, without a shuffle.
    """
    same = _same_size([F.col(name) for name in arrays])
    unequal = F.raise_error(F.lit("all fields must be arrays of the same length"))
    zipped = F.arrays_zip(*arrays)
    checked = F.when(same, zipped).otherwise(unequal.cast(df.select(zipped).schema[0].dataType))
    return df.select(*ids, F.posexplode(checked).alias("place", "_cells")).select(
        *ids, "place", "_cells.*"
    )


def transpose(rows: Column) -> Column:
    """Transpose an array of equally long arrays."""

    def turned(grid: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(F.element_at(grid, 1)) - 1)
        columns = F.transform(places, lambda i: F.transform(grid, lambda row: F.get(row, i)))
        return F.when(F.size(grid) == 0, grid).otherwise(columns)

    # The outer lambda binds the grid, which is then not made again for every place.
    return F.get(F.transform(F.array(rows), turned), F.lit(0))
