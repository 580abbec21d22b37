"""Choosing, moving, renaming and computing columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Span:
    """All columns from ``first`` to ``last`` in table order."""

    first: str
    last: str


def numbered(prefix: str, *items: int | str | range) -> list[str]:
    """Names made of a prefix and numbers, ranges or suffixes, first mention wins."""
    names: list[str] = []
    for item in items:
        names += [f"{prefix}{n}" for n in (item if isinstance(item, range) else [item])]
    return list(dict.fromkeys(names))


def resolve(df: DataFrame, items: Iterable[str | int | Span], strict: bool = True) -> list[str]:
    """Column names for names, 1-based positions and spans, without repeats.

    A name that does not exist is an error, or is skipped when not strict.
    """
    known = df.columns
    names: list[str] = []
    for item in items:
        if isinstance(item, Span):
            names += known[known.index(item.first) : known.index(item.last) + 1]
        elif isinstance(item, int):
            names.append(known[item - 1])
        else:
            names.append(item)
    names = list(dict.fromkeys(names))
    missing = [name for name in names if name not in known]
    if missing and strict:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return [name for name in names if name in known]


def _quoted(names: Iterable[str]) -> list[str]:
    return [f"`{name.replace('`', '``')}`" for name in names]


def pick(df: DataFrame, *items: str | int | Span, strict: bool = True) -> DataFrame:
    return df.select(*_quoted(resolve(df, items, strict)))


def without(df: DataFrame, *items: str | int | Span) -> DataFrame:
    return df.drop(*resolve(df, items))


def pick_renamed(df: DataFrame, **sources: str) -> DataFrame:
    """Select and rename at once: ``new="old"``."""
    return df.select(*[F.col(_quoted([old])[0]).alias(new) for new, old in sources.items()])


def rename_at(df: DataFrame, names: dict[int, str]) -> DataFrame:
    """Rename by 1-based position."""
    return df.toDF(*[names.get(i, old) for i, old in enumerate(df.columns, start=1)])


def to_front(df: DataFrame, prefix: str) -> DataFrame:
    front = [name for name in df.columns if name.startswith(prefix)]
    return pick(df, *front, *df.columns)


def reorder(df: DataFrame, order: list[int]) -> DataFrame:
    """Columns by a complete list of 1-based positions."""
    if sorted(order) != list(range(1, len(df.columns) + 1)):
        raise ValueError("an order must name every column once")
    return pick(df, *order)


def visible(base: DataFrame, shown: list[str], hide: list[str] = (), show: list[str] = (),
            reset: bool = False) -> list[str]:
    """The shown columns after hiding or showing some, in table order.

    A reset shows every column before hiding, or none before showing.
    """
    columns = base.columns
    if hide:
        start = columns if reset else shown
        return [name for name in columns if name in start and name not in hide]
    start = [] if reset else shown
    return [name for name in columns if name in start or name in show]


def compute(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns one after another; later ones may use earlier ones."""
    for name, column in columns.items():
        df = df.withColumn(name, column)
    return df


def across(df: DataFrame, names: Iterable[str], change: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({name: change(F.col(name)) for name in names})


def duplicate(df: DataFrame, **sources: str) -> DataFrame:
    """Copies of columns under further names."""
    return df.withColumns({new: F.col(old) for new, old in sources.items()})
