"""What several operators of this subpackage share."""

from __future__ import annotations

import atexit
import functools
import inspect
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wavebook.session import literal_table, materialise, scratch_path

# A key counts as hot above this share of the rows, so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 0.001

# Rows of a group are dealt into this many slices before their running totals are taken.
SLICES = 4096

# Rows for a file of a stored table whose number of rows is known.
FILE_ROWS = 1 << 17


def store(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder once and read from there.

    For loops: unlike a checkpoint, the table read back brings no derived constraints
    with it, which would grow from round to round in the driver. ``rows``: at most so many rows
    of a few numbers, so a small table doesn't become a file for every partition of its shuffle. It
    only decides how many tasks write.
    """
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_by(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """``store`` in buckets by a column: joins and groups by it read the table without moving its rows.

    A table of the session's catalog, under a name of its own, in the shared scratch folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    name = f"wavebook_{path.rpartition('-')[2]}"
    df.write.bucketBy(buckets, column).option("path", path).saveAsTable(name, format="parquet")
    atexit.register(_forget, spark, name)
    return spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    jsc = spark.sparkContext._jsc
    if jsc is not None and not jsc.sc().isStopped():
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder, with the columns it has."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def with_outputs(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add.

    An output column replaces an input column of the same name.
    """
    lowered = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lowered])


def shielded(*named: str, outputs: list[str]) -> Callable:
    """Make an operator safe from any column name of its input.

    The operator takes a DataFrame ``df``, column names in the arguments ``named`` and
    ``carry``, the columns that come back (None: all; no such argument: none). It sees only the columns asked
    for, under names of its own, found by position, so that no helper column can clash
    with them; the names return at the end. A carried column with the name of an
    output, in either case, is left out for the output. Two columns whose names differ
    in case only are told apart by their exact names.
    """

    def wrap(operator: Callable) -> Callable:
        signature = inspect.signature(operator)

        @functools.wraps(operator)
        def run(*args, **options) -> DataFrame:
            bound = signature.bind(*args, **options)
            bound.apply_defaults()
            given = bound.arguments
            df = given["df"]
            exact = {c: i for i, c in reversed(list(enumerate(df.columns)))}
            folded = {c.lower(): i for c, i in reversed(exact.items())}
            plain = df.toDF(*[f"_in_{i}" for i in range(len(df.columns))])

            def place(name: str) -> Column:
                at = exact.get(name, folded.get(name.lower()))
                if at is None:
                    raise ValueError(f"no column {name!r} in {df.columns}")
                return F.col(f"_in_{at}")

            hidden = {n.lower() for n in outputs}
            carry = given.get("carry", [])
            carry = df.columns if carry is None else carry
            kept = [c for c in carry if c.lower() not in hidden]
            inside = {f"_kept_{i}": c for i, c in enumerate(kept)}
            asked = {n: given[n] for n in named if given[n] is not None}
            given["df"] = plain.select(
                *[place(c).alias(i) for i, c in inside.items()], *[place(c).alias(f"_of_{n}") for n, c in asked.items()]
            )
            if "carry" in given:
                given["carry"] = list(inside)
            given.update({n: f"_of_{n}" for n in asked})
            out = operator(*bound.args, **bound.kwargs)
            more = [c for c in out.columns if c not in inside]
            return out.select(*[F.col(i).alias(c) for i, c in inside.items()], *more)

        return run

    return wrap


def join_counted(df: DataFrame, lookup: DataFrame, on: list[str], size: str, rows: int) -> DataFrame:
    """Left join with a lookup that knows how many rows of ``df`` each of its keys has.

    ``lookup`` has one row per key. Keys with over ``HOT_SHARE`` of the ``rows``
    are a thousand at most, so they are broadcast and their rows stay where they
    are; the rest, none of them large, are shuffled. ``df`` is read twice, so it
    should be stored.
    """
    hot = F.col(size) > F.lit(rows * HOT_SHARE)
    few = F.broadcast(lookup.where(hot))
    many = lookup.where(~hot)
    at_home = df.join(few, on, "inner")
    others = df.join(F.broadcast(few.select(*on)), on, "left_anti").join(many, on, "left")
    columns = df.columns + [c for c in lookup.columns if c not in on]
    return at_home.select(*columns).unionByName(others.select(*columns))


def running_total(
    df: DataFrame, group: list[str], order: list[Column], value: Column, before: str, slice_by: Column
) -> DataFrame:
    """Add ``before``: the sum of ``value`` over earlier rows of the same group.

    A group of any size is dealt into ``SLICES`` slices by ``slice_by``, a hash in
    whose order the rows come (``order`` must start with it): sums inside a slice
    come from a window over (group, slice), sums of earlier slices from the slice
    totals, ``SLICES`` rows for a group. ``slice_by`` must be between 0 and 1.
    """
    part, inside, offset = fresh(df, "_slice", "_inside", "_offset")
    df = df.withColumn(part, F.least(F.floor(slice_by * SLICES), F.lit(SLICES - 1)).cast("int"))
    keys = [F.col(g) for g in group]
    totals = df.groupBy(*keys, part).agg(F.sum(value).alias(offset))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn(offset, F.coalesce(F.sum(offset).over(earlier), F.lit(0)))
    renamed = offsets.withColumnsRenamed({g: f"_of_{g}" for g in group} | {part: f"_of_{part}"})
    same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in [*group, part]]
    in_slice = (
        Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = df.withColumn(inside, F.coalesce(F.sum(value).over(in_slice), F.lit(0)))
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return (
        placed.join(renamed, condition, "left")
        .withColumn(before, F.col(offset) + F.col(inside))
        .drop(inside, offset, part, *[f"_of_{g}" for g in [*group, part]])
    )


def literal_shards(spark: SparkSession, blocks: list[tuple[int, int, int, int]]) -> DataFrame:
    """(old_shard, shard, low, high): the blocks that a flow between shards gives."""
    schema = pa.schema([("old_shard", pa.int32()), ("shard", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])
    return literal_table(spark, schema, blocks)


__all__ = [
    "FILE_ROWS", "HOT_SHARE", "SLICES", "fresh", "join_counted", "literal_shards", "materialise", "running_total", "shielded",
    "store", "store_by", "table", "with_outputs",
]
