"""What a displayed table asks for: counts, pages, row ids, blocks.

An order is a list of (column, descending). Missing values come first in a rising
column and last in a falling one. The columns together must be unique, so that
every row has one place; rows that share a place on a page are an error.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from wavebook.operators.predicates import all_of
from wavebook.operators.ranking import SHALLOW_ROWS, number_rows
from wavebook.session import materialise

# Ranges a table is counted by to find a page far down.
RANGES = 64

Order = list[tuple[str, bool]]


def sort_columns(order: Order) -> list[Column]:
    return [F.col(name).desc() if descending else F.col(name).asc() for name, descending in order]


def info(df: DataFrame, condition: Column, page_length: int) -> DataFrame:
    """(total, filtered, pages) in one pass."""
    return df.agg(
        F.count("*").alias("total"), F.count_if(condition).alias("filtered")
    ).select("total", "filtered", F.ceil(F.col("filtered") / page_length).alias("pages"))


def page(
    df: DataFrame, order: Order, number: int, length: int, shallow_rows: int = SHALLOW_ROWS
) -> DataFrame:
    """Page ``number`` of a table; a page out of range is an error, and so is an order
    that gives two rows one place on it.

    Pages near the start are cut from short top lists. For a page far down the rows
    are counted by ranges of the first order column, and only the ranges that hold
    the page are sorted.
    """
    start = (number - 1) * length
    if number < 1:
        raise ValueError("selected page is out of range")
    names = [name for name, _ in order]
    skipped = 0
    if start + length <= shallow_rows:
        # One row more than the page, to see whether its last place is shared.
        rows = df.orderBy(*sort_columns(order)).limit(start + length + 1)
    else:
        rows, skipped = _ranges_of(df, order, start, length)
    places = materialise(
        number_rows(rows, sort_columns(order), "_row").where(
            F.col("_row").between(start - skipped, start - skipped + length + 1)
        )
    )
    if not places.groupBy(*names).count().where("count > 1").isEmpty():
        raise ValueError(f"the order {names} gives several rows the same place")
    chosen = places.where(F.col("_row").between(start - skipped + 1, start - skipped + length)).drop("_row")
    if chosen.isEmpty():
        raise ValueError("selected page is out of range")
    return chosen


def _ranges_of(df: DataFrame, order: Order, start: int, length: int) -> tuple[DataFrame, int]:
    """The rows of the ranges that hold rows ``start`` to ``start + length + 1``, and the
    number of rows before them. Ranges are cut at sampled values of the first order column."""
    name, descending = order[0]
    value = F.col(name)
    sample = df.select(name).where(value.isNotNull()).sample(fraction=0.05, seed=7).limit(10_000)
    found = sorted({row[0] for row in sample.collect()})
    cuts = found[:: max(1, len(found) // RANGES)]
    above = F.array_size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= value)) if cuts else F.lit(0)
    # 0: missing values; 1: below the first cut.
    counts = dict(df.groupBy(F.when(value.isNull(), 0).otherwise(above + 1).alias("range")).count().collect())
    wanted, before, skipped = [], 0, 0
    for place in sorted(counts, reverse=descending):
        if before + counts[place] >= max(start, 1) and before < start + length + 1:
            if not wanted:
                skipped = before
            wanted.append(place)
        before += counts[place]
    low, high = (min(wanted), max(wanted)) if wanted else (0, 0)
    bounds = [value >= cuts[low - 2] if low >= 2 else None, value < cuts[high - 1] if 1 <= high <= len(cuts) else None]
    inside = value.isNotNull() & all_of(bounds) if high else F.lit(False)
    return df.where(inside | value.isNull() if low == 0 else inside), skipped


def row_ids(df: DataFrame, condition: Column, id_order: Order, shown: Order, length: int) -> DataFrame:
    """(row_id, position, page) of the rows passing a filter.

    ``row_id`` is the place in the whole table, ``position`` the place among
    the rows shown. Only the order columns are sorted.
    """
    names = dict.fromkeys(name for name, _ in [*id_order, *shown])
    narrow = df.select(*names, condition.alias("_kept"))
    kept = number_rows(narrow, sort_columns(id_order), "row_id").where("_kept")
    placed = number_rows(kept.select("row_id", *dict.fromkeys(n for n, _ in shown)), sort_columns(shown), "position")
    return placed.select("row_id", "position", F.ceil(F.col("position") / length).alias("page"))


def row_block(df: DataFrame, key: str, start, end, order: Order) -> DataFrame:
    """Rows from one row to another in displayed order, whichever comes first.

    The places of the two rows are looked up; the block is then a filter that
    reaches the scan, and nothing is sorted or numbered. A row that does not
    exist gives an empty block; another row in the place of one of the two is an
    error.
    """
    names = list(dict.fromkeys(name for name, _ in order))
    edges = (
        df.where(F.col(key).isin([start, end])).orderBy(*sort_columns(order)).select(*names).limit(3).collect()
    )
    if len(edges) < len({start, end}):
        return df.where(F.lit(False))
    first, last = edges[0], edges[-1]

    def at(edge) -> Column:
        return all_of([F.col(name).eqNullSafe(F.lit(edge[name])) for name in names])

    if len(edges) > 2 or df.where(at(first) | at(last)).limit(3).count() > len({start, end}):
        raise ValueError(f"the order {names} gives several rows the same place")

    def beyond(name: str, value, rising: bool) -> Column:
        """Above (below) a value; missing values are below all others."""
        column = F.col(name)
        if rising:
            return column.isNotNull() if value is None else column > F.lit(value)
        return F.lit(False) if value is None else column.isNull() | (column < F.lit(value))

    def reaches(edge, backwards: bool) -> Column:
        """The row has the place of the edge, or one after (before) it."""
        steps, same = [], []
        for name, descending in order:
            steps.append(all_of([*same, beyond(name, edge[name], descending == backwards)]))
            same.append(F.col(name).eqNullSafe(F.lit(edge[name])))
        return reduce(or_, steps, all_of(same))

    name, descending = order[0]
    low, high = (last[name], first[name]) if descending else (first[name], last[name])
    # A plain range of the first column, which the scan can use.
    bounds = [
        F.col(name) >= F.lit(low) if low is not None else None,
        F.col(name) <= F.lit(high) if high is not None else F.lit(False),
    ]
    inside = all_of(bounds)
    span = inside if low is not None else inside | F.col(name).isNull()
    return df.where(span & reaches(first, False) & reaches(last, True))
