"""Key sets shared between views: filters, selections and their changes.

A key set is a one-column table of unique keys. ``None`` means "no filter" and
is not the same as an empty key set, which lets nothing through.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wavebook.operators import key_bits
from wavebook.operators.predicates import all_of


def _key_set(members: DataFrame, key: str, unique: bool) -> DataFrame:
    keys = members.select(F.col(key).alias("key"))
    return keys.distinct() if unique else keys


def option_keys(
    members: DataFrame, option: str, key: str, ticked: list[str], unique: bool = True
) -> DataFrame | None:
    """Keys of all ticked options; ticking nothing clears the filter.

    ``unique=False`` leaves keys repeated, and saves a shuffle, where ``keep_linked`` merges them.
    """
    if not ticked:
        return None
    return _key_set(members.where(F.col(option).isin(ticked)), key, unique)


def slider_keys(
    members: DataFrame, key: str, value: Column, low=None, high=None, kind: str = "number", unique: bool = True
) -> DataFrame:
    """Keys with low <= value <= high. Matching nothing gives an empty key set.

    Bounds are numbers, UTC dates as ISO text (``date``, the last day is part of
    the range), or seconds since 1970 (``datetime``). They are turned into
    values of the column's own kind, so that the filter reaches the scan.
    """
    below = value <= high
    if kind == "date":
        low = None if low is None else F.lit(low).cast("timestamp_ntz")
        if high is not None:
            below = value < F.date_add(F.lit(high).cast("date"), 1).cast("timestamp_ntz")
    elif kind == "datetime":
        clock = members.select(value).schema[0].dataType.typeName()
        low, high = (None if bound is None else _moment(bound, clock) for bound in (low, high))
        below = value <= high
    elif kind != "number":
        raise ValueError(f"unknown slider kind {kind!r}")
    bounds = [value >= low if low is not None else None, below if high is not None else None]
    kept = members.where(value.isNotNull() & all_of(bounds))
    return _key_set(kept, key, unique)


def _moment(seconds: float, clock: str) -> Column:
    """A point in time; a clock without a zone shows UTC."""
    moment = datetime(1970, 1, 1) + timedelta(seconds=seconds)
    return F.lit(f"{moment}" if clock == "timestamp_ntz" else f"{moment}Z").cast(clock)


def intersect(filters: dict[str, DataFrame | None]) -> DataFrame | None:
    """Keys held by every active filter, or ``None`` if no filter is active.

    All filters are read in one union and merged: one shuffle however many filters
    there are. Whole numbers are merged as bits (``key_bits``), other keys as they are.
    """
    active = [keys for keys in filters.values() if keys is not None]
    if not active:
        return None
    if len(active) == 1:
        return active[0]
    if all(map(key_bits.is_whole, active)):
        return key_bits.unpack(key_bits.intersect(active), active[0].schema["key"].dataType.simpleString())
    tagged = [k.select("key", F.lit(i).alias("filter")) for i, k in enumerate(active)]
    merged = reduce(DataFrame.unionAll, tagged).groupBy("key").agg(F.size(F.collect_set("filter")).alias("held"))
    return merged.where(F.col("held") == len(active)).select("key")


def clear(filters: dict[str, DataFrame | None], name: str | None = None) -> dict:
    """The filters without one of them, or without any."""
    return {} if name is None else {k: v for k, v in filters.items() if k != name}


def apply(df: DataFrame, key: str, keys: DataFrame | None) -> DataFrame:
    """Rows whose key is in the shared set; ``None`` keeps all rows."""
    if keys is None:
        return df
    return df.join(keys.withColumnRenamed("key", key), key, "left_semi")


def keep_linked(df: DataFrame, key: str, filters: dict[str, DataFrame | None]) -> DataFrame:
    """Rows whose key is held by every active filter; without one, all rows.

    Sets of whole numbers stay packed as bits up to the join, and may hold a key many times.
    """
    active = [keys for keys in filters.values() if keys is not None]
    if active and key_bits.is_whole(df, key) and all(map(key_bits.is_whole, active)):
        return key_bits.keep(df, key, key_bits.intersect(active))
    return apply(df, key, intersect(filters))


def select(previous: DataFrame | None, chosen: DataFrame | None, persistent: bool = False) -> DataFrame | None:
    """The new selection replaces the old one, or is added to it when persistent."""
    if chosen is None or not persistent or previous is None:
        return chosen
    return previous.select("key").unionAll(chosen.select("key")).distinct()


def changes(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """(key, change) with ``added`` and ``removed``; a repeated key is an error."""
    sides = [(before, 1), (after, 2)]
    given = [(keys, bit) for keys, bit in sides if keys is not None]
    if not given:
        raise ValueError("both key sets are missing")
    tagged = [keys.select("key", F.lit(bit).alias("bit")) for keys, bit in given]
    merged = reduce(DataFrame.unionAll, tagged).groupBy("key").agg(
        F.sum("bit").alias("seen"), F.bit_or("bit").alias("side")
    )
    repeated = F.raise_error(F.lit("key set contains duplicates")).cast("string")
    change = F.when(F.col("seen") != F.col("side"), repeated).when(F.col("side") == 1, "removed")
    return merged.where("side < 3 or seen <> side").select(
        "key", change.otherwise("added").alias("change")
    )
