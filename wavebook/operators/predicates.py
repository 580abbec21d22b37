"""Row filters, among them the column filters of a displayed table."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from wavebook.functions.text import plain_number, words_of
from wavebook.operators.columns import resolve


def all_of(conditions: Iterable[Column | None]) -> Column:
    """Every active condition; inactive ones are ``None``."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def matching(df: DataFrame, predicate: str) -> DataFrame:
    """Rows for which a condition written as text holds."""
    return df.where(predicate)


def until(year: Column, key: Column, limit: int, exceptions: dict[str, int]) -> Column:
    """``year <= limit``, with other limits for some keys. A missing key never passes.

    The highest limit is a condition of its own, which needs the year only and
    so can be checked before the key is known.
    """
    bound = F.lit(limit)
    for name, other in exceptions.items():
        bound = F.when(key == name, other).otherwise(bound)
    highest = max([limit, *exceptions.values()])
    return key.isNotNull() & (year <= highest) & (year <= bound)


def drop_missing(df: DataFrame, columns: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Drop rows missing in the given columns, or anywhere."""
    if columns is None:
        return df.dropna("any")
    names = resolve(df, columns, strict)
    return df.dropna("any", subset=names) if names else df


def in_range(
    value: Column,
    low: float | None,
    high: float | None,
    domain: tuple[float, float] | None = None,
    text: bool = False,
) -> Column | None:
    """Inclusive number filter. A range covering the whole domain filters nothing.

    A narrower range drops everything that is not a number. ``None`` is an open end.
    Numbers are compared in their own type, so the filter reaches the scan; a column
    of ``text`` is read as numbers first.
    """
    if domain is not None:
        low = None if low is not None and low <= domain[0] else low
        high = None if high is not None and high >= domain[1] else high
    if low is None and high is None:
        return None
    number = value.try_cast("double") if text else value
    bounds = [
        number >= low if low is not None else None,
        number <= high if high is not None else None,
    ]
    return ~F.isnan(number) & all_of(bounds)


def in_period(value: Column, low: str | None, high: str | None) -> Column | None:
    """Inclusive date or time filter; bounds are UTC dates or times as text."""
    if low is None and high is None:
        return None
    bounds = [
        value >= F.lit(low).cast("timestamp_ntz") if low is not None else None,
        value <= F.lit(high).cast("timestamp_ntz") if high is not None else None,
    ]
    return all_of(bounds)


def in_years(value: Column, first: int, last: int) -> Column:
    """Dates or times in a span of years, as a range that reaches the scan."""
    start, end = (F.lit(f"{year:04d}-01-01").cast("timestamp_ntz") for year in (first, last + 1))
    return (value >= start) & (value < end)


def one_of(value: Column, chosen: list) -> Column | None:
    """Category filter; choosing nothing keeps every row."""
    return value.isin(chosen) if chosen else None


def flag_in(value: Column, chosen: list[str]) -> Column | None:
    """Filter on a logical column by ``true``, ``false`` and ``na`` (missing)."""
    return F.coalesce(value.cast("string"), F.lit("na")).isin(chosen) if chosen else None


def cell_text(df: DataFrame, name: str) -> Column:
    """A cell as a browser shows it: numbers in plain digits, missing as empty."""
    return F.coalesce(plain_number(F.col(name), df.schema[name].dataType.typeName()), F.lit(""))


def text_matches(text: Column, query: str, regex: bool = False, ignore_case: bool = True) -> Column:
    """Plain mode: every word occurs. Regex mode: the pattern occurs."""
    if regex:
        return text.rlike(f"(?i){query}" if ignore_case else query)
    words = query.split()
    if ignore_case:
        text, words = F.lower(text), words_of(query)
    return all_of([F.contains(text, F.lit(word)) for word in words])


def search_column(df: DataFrame, name: str, query: str, regex: bool = False,
                  ignore_case: bool = True) -> DataFrame:
    return df.where(text_matches(cell_text(df, name), query, regex, ignore_case))


def search_everywhere(df: DataFrame, query: str, regex: bool = False,
                      ignore_case: bool = True) -> DataFrame:
    """Words may be spread over several columns."""
    row = F.concat_ws(" ", *[cell_text(df, name) for name in df.columns])
    return df.where(text_matches(row, query, regex, ignore_case))


def _since_1970(value: Column, kind: str) -> Column:
    """Milliseconds since 1970 of a date or time; a clock without a zone shows UTC."""
    if kind == "timestamp":
        return F.unix_millis(value).cast("double")
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_diff("MILLISECOND", start, value.cast("timestamp_ntz")).cast("double")


def domains(df: DataFrame, numbers: list[str], options: list[str]) -> DataFrame:
    """(column, low, high, option): ranges of numbers, dates and times, and category
    options, in one scan.

    Dates and times are in milliseconds since 1970. Every row is turned into one
    (column, value) pair per column; equal options are merged before the shuffle.
    """

    def number(name: str) -> Column:
        kind = df.schema[name].dataType.typeName()
        timed = kind in ("date", "timestamp", "timestamp_ntz")
        return _since_1970(F.col(name), kind) if timed else F.col(name).cast("double")

    none = {"number": F.lit(None).cast("double"), "option": F.lit(None).cast("string")}
    values = [(name, none | {"number": number(name)}) for name in numbers]
    values += [(name, none | {"option": F.col(name).cast("string")}) for name in options]
    pairs = [
        F.struct(F.lit(name).alias("column"), *[c.alias(k) for k, c in pair.items()]) for name, pair in values
    ]
    return (
        df.select(F.inline(F.array(*pairs)))
        .groupBy("column", "option")
        .agg(F.min("number").alias("low"), F.max("number").alias("high"))
        .where(F.col("option").isNotNull() | F.col("low").isNotNull())
        .select("column", "low", "high", "option")
    )
