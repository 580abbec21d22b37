"""Exact dedup with two Bloom filter passes.

Pass one reads a 64-bit hash per row and keeps, in a filter of fixed size, the
hashes that were seen again. Pass two tests every row against that filter: a row
that cannot be a repeat passes straight through, and only possible repeats are
shuffled and compared by their whole digest. A false positive of the filter costs
a shuffled row, never a wrong answer, so the result is exact at any load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wavebook.llm.common import fresh, join_counted, materialise, shielded

# Words of 64 bits. The broadcast filter holds at most that many rows of 16 bytes.
FILTER_WORDS = 1 << 21

OUTPUTS = ["keep_id", "group_size", "kept", "text_sha256"]
BLANKS = r"[\x20\x09-\x0D]+"


def _word(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(FILTER_WORDS))


def _bits(digest: Column) -> Column:
    """Three bits of a word, from a second hash."""
    second = F.xxhash64(digest, F.lit(1))
    bit = [
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(second, s), F.lit(64)).cast("int"))
        for s in (0, 6, 12)
    ]
    return bit[0].bitwiseOR(bit[1]).bitwiseOR(bit[2])


def seen_again(digests: DataFrame, digest: str) -> DataFrame:
    """(word, again): the bits of the hashes that more than one row has.

    Equal hashes are merged before the shuffle, so a hot text is one row per task.
    At most ``FILTER_WORDS`` rows come out.
    """
    return (
        digests.groupBy(_word(F.col(digest)).alias("word"), _bits(F.col(digest)).alias("bits"))
        .count()
        .where("count > 1")
        .groupBy("word")
        .agg(F.bit_or("bits").alias("again"))
    )


@shielded("text", "id_column", outputs=OUTPUTS)
def exact_dedup(
    df: DataFrame, text: str = "text", id_column: str = "doc_id", carry: list[str] | None = None
) -> DataFrame:
    """Mark the row that stays of every group of texts equal but for blanks.

    Returns the ``carry`` columns (all by default) and ``keep_id``, ``group_size``,
    ``kept`` and ``text_sha256`` of the text without blanks. Of a group the row
    with the most code points stays, then the smallest id (a missing id comes
    last); of rows equal in both, the first read. A null text counts as empty, and
    empty texts equal each other. An empty table gives no rows. Columns of any
    name are carried; those of the outputs' names are replaced.

    The carried columns are stored once with the digest in the session's shared
    checkpoint folder; leave the text out of ``carry`` to keep that table narrow.
    """
    key, digest, points, row, again = fresh(df, "_key", "_digest", "_points", "_row", "_again")
    whole = F.coalesce(F.col(text), F.lit(""))
    digests = materialise(
        df.select(
            *[F.col(f"`{c}`") for c in carry],
            F.col(id_column).alias(key),
            F.unhex(F.sha2(F.regexp_replace(whole, BLANKS, ""), 256)).alias(digest),
            F.char_length(whole).alias(points),
            F.monotonically_increasing_id().alias(row),
        )
    )
    rows = digests.count()
    twice = materialise(seen_again(digests, digest)).withColumnsRenamed({"again": again})
    tested = digests.withColumn("word", _word(F.col(digest))).join(F.broadcast(twice), "word", "left")
    bits = _bits(F.col(digest))
    maybe = F.coalesce(F.col(again).bitwiseAND(bits) == bits, F.lit(False))
    alone = tested.where(~maybe).select(
        *carry, F.col(key).alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), F.lower(F.hex(digest)).alias("text_sha256"),
    )
    possible = tested.where(maybe).select(*carry, key, digest, points, row)
    best = F.min(F.struct((-F.col(points)).alias("p"), F.col(key).isNull().alias("n"), F.col(key).alias("i"), F.col(row).alias("r")))
    groups = possible.groupBy(digest).agg(best.alias("_best"), F.count("*").alias("group_size"))
    chosen = groups.select(
        digest, "group_size", F.col("_best.i").alias("keep_id"), F.col("_best.r").alias("_best_row")
    )
    joined = join_counted(possible, materialise(chosen), [digest], "group_size", rows)
    return alone.unionByName(
        joined.select(
            *carry, "keep_id", "group_size", (F.col(row) == F.col("_best_row")).alias("kept"),
            F.lower(F.hex(digest)).alias("text_sha256"),
        )
    )
