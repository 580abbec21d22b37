"""Sets of whole-number keys as bits, 64 keys to a row.

A packed set is a table (bucket, bits): the key without its last six bits, and a word with
one bit for each of the 64 keys of that bucket. Sets merge by ``bit_or`` and meet by ``&``
inside generated code. Where keys are dense a row of 16 bytes stands for up to 64
of them; where they are sparse it stands for one, which is no more than the key itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

WHOLE = ("byte", "short", "integer", "long")


def is_whole(keys: DataFrame, key: str = "key") -> bool:
    """Whether a column of keys can be packed."""
    return keys.schema[key].dataType.typeName() in WHOLE


def bucket_of(key: Column) -> Column:
    return F.shiftright(key.cast("bigint"), 6)


def bit_of(key: Column) -> Column:
    """A word with the bit of one key; negative keys have theirs in buckets below zero."""
    place = key.cast("bigint").bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def _tagged(sets: list[DataFrame]) -> DataFrame:
    parts = [
        keys.where("key is not null").select(
            bucket_of(F.col("key")).alias("bucket"), bit_of(F.col("key")).alias("bit"), F.lit(i).alias("filter")
        )
        for i, keys in enumerate(sets)
    ]
    return reduce(DataFrame.unionAll, parts)


def intersect(sets: list[DataFrame]) -> DataFrame:
    """The packed set of keys that all of some key tables hold.

    Keys may repeat and a missing one belongs to no set. One shuffle of
    buckets, whatever the number of sets: each task merges its keys first.
    """
    merged = _tagged(sets).groupBy("bucket").agg(
        *[F.bit_or(F.when(F.col("filter") == i, F.col("bit"))).alias(f"in_{i}") for i in range(len(sets))]
    )
    # A set without a key in the bucket is null, and so is all that it meets.
    bits = reduce(Column.bitwiseAND, [F.col(f"in_{i}") for i in range(len(sets))])
    return merged.select("bucket", bits.alias("bits")).where("bits <> 0")


def union(sets: list[DataFrame]) -> DataFrame:
    """The packed set of keys that any of some key tables holds."""
    return _tagged(sets).groupBy("bucket").agg(F.bit_or("bit").alias("bits"))


def unpack(packed: DataFrame, kind: str = "bigint") -> DataFrame:
    """The keys of a packed set, each once, as a column ``key`` of a type."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    key = F.call_function("shiftleft", F.col("bucket"), F.lit(6)) + F.col("place")
    return packed.select("bucket", F.explode(places).alias("place")).select(key.cast(kind).alias("key"))


def keep(df: DataFrame, key: str, packed: DataFrame) -> DataFrame:
    """Rows whose key is in a packed set, which is joined as it is."""
    taken = {c.lower() for c in df.columns}
    bucket, bits = (next(n for n in (f"{'_' * i}{name}" for i in range(1, 99)) if n not in taken) for name in ("bucket", "bits"))
    own = packed.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))
    here = F.col(bits).bitwiseAND(bit_of(F.col(f"`{key}`"))) != 0
    return df.join(own, (bucket_of(F.col(f"`{key}`")) == F.col(bucket)) & here, "left_semi")
