"""Equi-joins, crosswalks and matching checks."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from wavebook.operators.predicates import all_of
from wavebook.session import materialise

# A side is broadcast up to this many rows and bytes, both measured; beyond them hot keys are salted.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024**2
SALTS = 64

# A key with more than this share of the rows is hot. So there are at most HOT_KEYS of them.
HOT_SHARE = 0.01
HOT_KEYS = 100
TRACKED_KEYS = 10_000


def hot_keys(df: DataFrame, on: list[str]) -> list[int]:
    """Hashes of the keys that hold a large share of the rows.

    A frequent-items sketch of one column finds them in one pass without a
    shuffle of the rows. It only decides how rows are spread, never which rows
    are joined.
    """
    top = F.call_function(
        "approx_top_k", F.xxhash64(*on), F.lit(HOT_KEYS), F.lit(TRACKED_KEYS)
    )
    found = df.agg(top.alias("top"), F.count("*").alias("n")).first()
    return [key for key, count in found.top if count > found.n * HOT_SHARE]


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a table: what its texts and fixed-width values take."""
    width = F.lit(16)
    for field in df.schema:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(f"`{field.name}`"), F.lit(0))
        elif kind in ("array", "map", "struct", "variant"):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(f"`{field.name}`"))), F.lit(0))
        else:
            width = width + F.lit(8)
    found = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return found.rows, found.bytes


def one_per_key(lookup: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The lookup, made to fail when it lists a key twice: a join would multiply rows."""
    others = [name for name in lookup.columns if name not in keys]
    row = F.struct(*others)
    listed = F.concat_ws(", ", *[F.col(name).cast("string") for name in keys])
    twice = F.raise_error(F.concat(F.lit(f"{what} lists a key twice: "), listed))
    kind = lookup.select(row.alias("row")).schema["row"].dataType
    return (
        lookup.groupBy(*keys)
        .agg(F.when(F.count("*") > 1, twice.cast(kind)).otherwise(F.first(row)).alias("_row"))
        .select(*keys, "_row.*")
    )


def sized_join(
    df: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "left",
    reduced: bool = True,
    nulls_match: bool = True,
    broadcast_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join rows with a smaller table that has one row per key.

    The smaller table is measured, and written first if it is the ``reduced``
    result of other work. Small in rows and bytes, it is broadcast and the rows
    are not shuffled.
    Large, both sides are shuffled; the rows of hot keys are spread over
    ``salts`` buckets by a hash of the whole row and the few matching rows of
    the other side are copied to each bucket.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join {how!r}")
    small = small.withColumnsRenamed({name: f"_{name}" for name in on})
    small = materialise(small) if reduced else small
    pairs = [(F.col(name), F.col(f"_{name}")) for name in on]
    same = [a.eqNullSafe(b) if nulls_match else a == b for a, b in pairs]
    rows, size = measured(small)
    if rows <= broadcast_rows and size <= BROADCAST_BYTES:
        joined = df.join(F.broadcast(small), all_of(same), how)
    elif hot := hot_keys(df, on):
        keys = [F.col(f"_{name}").cast(df.schema[name].dataType) for name in on]
        bucket = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")
        buckets = F.when(
            F.xxhash64(*keys).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))
        ).otherwise(F.array(F.lit(0)))
        salted = df.withColumn("_salt", F.when(F.xxhash64(*on).isin(hot), bucket).otherwise(0))
        copies = small.withColumn("_copy", F.explode(buckets))
        joined = salted.join(copies, all_of([*same, F.col("_salt") == F.col("_copy")]), how)
    else:
        joined = df.join(small, all_of(same), how)
    return joined.select(*_columns(df, small, on, how))


def _columns(df: DataFrame, small: DataFrame, on: list[str], how: str) -> list[str]:
    if how in ("left_semi", "left_anti"):
        return df.columns
    keys = [f"_{name}" for name in on]
    return df.columns + [name for name in small.columns if name not in keys]


def inner_pick(
    left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str] = ("_x", "_y")
) -> DataFrame:
    """Inner join; columns found on both sides get a suffix instead of clashing."""
    both = (set(left.columns) & set(right.columns)) - {key}
    x = left.withColumnsRenamed({name: name + suffixes[0] for name in both})
    y = right.withColumnsRenamed({name: name + suffixes[1] for name in both})
    return x.join(y, key, "inner")


def left_merge(tables: Iterable[DataFrame], key: str) -> DataFrame:
    """Left joins folded over a list of tables.

    No hints: Spark broadcasts a table by its own size check, and at run time
    splits a key of the first table that is much larger than the rest.
    """
    return reduce(lambda left, right: left.join(right, key, "left"), tables)


def crosswalk(df: DataFrame, codes: DataFrame, column: str, origin: str, destination: str) -> DataFrame:
    """Add the ``destination`` code for the ``origin`` code in ``column``; unknown is missing.

    An origin listed twice is an error.
    """
    pairs = codes.select(F.col(origin).alias("_origin"), F.col(destination).alias(f"_{destination}"))
    pairs = one_per_key(pairs.where("_origin is not null"), ["_origin"], "the crosswalk")
    return (
        df.join(pairs, F.col(column) == F.col("_origin"), "left")
        .drop("_origin")
        .withColumnRenamed(f"_{destination}", destination)
    )


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys found on one side only, in one grouping.

    Equal keys are merged before the shuffle, so a hot key costs one row per task.
    """
    sides = left.select(F.col(key).alias("key"), F.lit(1).alias("side")).union(
        right.select(F.col(key).alias("key"), F.lit(2).alias("side"))
    )
    return (
        sides.where("key is not null")
        .groupBy("key")
        .agg(F.bit_or("side").alias("seen"))
        .where("seen < 3")
        .select("key", F.when(F.col("seen") == 1, "left only").otherwise("right only").alias("side"))
    )


def keep_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed. The list is made unique before it is shuffled."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed."""
    return df.join(keys.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def selectable(selected: list[int], rules: list[int]) -> list[int]:
    """Ids a user may select: positive rules allow, the others forbid, none allow all."""
    if not rules:
        return selected
    if rules[0] <= 0:
        denied = {-rule for rule in rules}
        return [i for i in selected if i not in denied]
    return [i for i in selected if i in set(rules)]
