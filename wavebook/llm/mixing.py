"""A low-discrepancy schedule that mixes sources to target weights.

Every source is shuffled and cut into blocks of equally many words. Slots of the
mixture are numbered, golden-ratio points of the numbers are mapped through the
cumulative targets to a source, and the r-th slot of a source takes its r-th
block, starting again after the last. Any stretch of slots holds each source
nearly in its share, and nothing is drawn at random.

Blocks grow with the tables, so a source of a few blocks gets no slot or too few. A source
whose slots miss its target is settled exactly: all its words as often as they fit
into the target, and the first ones of the shuffled source once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wavebook.llm.common import fresh, materialise, running_total, shielded

# Slots of the mixture. Blocks grow with the tables, their number does not.
SLOTS = 1 << 18

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2

# Slots may miss a target by this share of it and so many words; beyond, the source is settled.
MISS_SHARE = 0.01
MISS_WORDS = 10

# 2^32 divided by the golden ratio, as a whole number.
GOLDEN = 2654435769
POINTS = 1 << 32
CELL = 1 << 20

WORD = r"[^\x20\x09-\x0D]+"
OUTPUTS = ["size", "source_size", "target", "taken", "copies"]


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """Add ``target`` to (source, source_size), one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share``
    of all sizes; a target stops at ``most`` times its source and the excess goes
    to the others by weight. In the end a target is the smaller of that limit and
    level * weight, so the level is found in the order of limit / weight.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(most))
    weighted = sizes.withColumn("weight", weight).withColumn("limit", limit)
    order = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    from_here = order.rowsBetween(0, Window.unboundedFollowing)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))
    ) / F.sum("weight").over(from_here)
    levels = weighted.withColumn("level", level)
    # The first source in that order that stays under its limit sets the level.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    found = F.first(fits, ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    own = F.least(F.col("limit"), F.coalesce(F.col("found") * F.col("weight"), F.col("limit")))
    return levels.withColumn("found", found).select("source", "source_size", own.alias("target"))


def schedule(sources: DataFrame, slots: int = SLOTS, most: int = MOST_REPEATS) -> DataFrame:
    """(slot, source, rank, block, block_words): which block each slot of the mixture takes.

    ``sources`` is what ``targets`` returns. Every slot has the same number of
    words, so that ``slots`` slots hold all targets. A slot beyond the last
    allowed repeat of its source stays empty and is left out.
    """
    spark = sources.sparkSession
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    share = sources.where("target > 0").withColumn("all_words", F.sum("target").over(every))
    share = share.withColumn("upto", F.floor(upto / F.col("all_words") * F.lit(float(POINTS))))
    share = share.select(
        "source", "source_size", "all_words", _block_words("all_words", slots).alias("block_words"),
        F.coalesce(F.lag("upto").over(order), F.lit(0)).alias("low"),
        F.when(F.lead("upto").over(order).isNull(), F.lit(POINTS)).otherwise(F.col("upto")).alias("high"),
    )
    # Points meet intervals by an equi-join on the leading bits, then by comparison.
    cells = F.sequence(F.expr(f"low div {CELL}"), F.expr(f"(high - 1) div {CELL}"))
    intervals = share.where("low < high").withColumn("cell", F.explode(cells))
    point = F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(POINTS))
    points = spark.range(slots).select(
        F.col("id").alias("slot"), point.alias("point"), F.expr(f"pmod(id * {GOLDEN}, {POINTS}) div {CELL}").alias("cell")
    )
    placed = points.join(intervals, "cell").where(
        "point >= low and point < high and slot < ceil(all_words / block_words)"
    )
    rank = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    return (
        placed.withColumn("rank", rank.cast("bigint"))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")))
        .where(F.col("rank") < F.col("blocks") * most)
        .select("slot", "source", "rank", F.pmod("rank", "blocks").alias("block"), "block_words")
    )


def _block_words(all_words: str, slots: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(all_words) / F.lit(slots))).cast("bigint")


def block_uses(slots: DataFrame) -> DataFrame:
    """(source, block, uses, used_before): how often the mixture takes each block.

    ``used_before`` is the number of words taken from earlier blocks of the source.
    At most as many rows as slots.
    """
    counted = slots.groupBy("source", "block", "block_words").agg(F.count("*").alias("uses"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("uses") * F.col("block_words")).over(earlier), F.lit(0))
    return counted.withColumn("used_before", before)


@shielded("text", "source", "id_column", outputs=OUTPUTS)
def mix(
    df: DataFrame,
    text: str = "text",
    source: str = "source",
    id_column: str = "doc_id",
    carry: list[str] | None = None,
    slots: int = SLOTS,
) -> DataFrame:
    """Say for every row how many of its words the mixture takes.

    Returns the ``carry`` columns (all by default) and ``size`` (words of the
    text), ``source_size`` (words of its source), ``target`` (words the mixture
    wants of it), ``taken`` (words of this row in the mixture, repeats counted, at
    most twice its size) and ``copies`` (how often the row's first word is taken: whole
    rows repeated that often come near the targets, too).

    Rows of a source are shuffled by a digest of id and text, so reruns agree; rows
    equal in both are alike. A null text has no words; a null source is a source
    of its own, the last; rows without words have ``taken`` and ``copies`` 0. An
    empty table gives no rows. Columns of any name are carried; those of the outputs'
    names are replaced.

    The carried columns are stored once in the session's shared checkpoint folder;
    leave the text out of ``carry`` to keep that table narrow.
    """
    src, digest, start = fresh(df, "_source", "_digest", "_start")
    whole = F.coalesce(F.col(text), F.lit(""))
    seed = F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit("\n"), whole))
    sized = materialise(
        df.select(
            *[F.col(f"`{c}`") for c in carry],
            F.col(source).alias(src), words(F.col(text)).alias("size"), seed.alias(digest),
        )
    )
    sizes = sized.groupBy(F.col(src).alias("source")).agg(F.sum("size").alias("source_size"))
    wanted = materialise(targets(sizes))
    uses = materialise(block_uses(schedule(wanted, slots)))
    # The last block of a source may be short: ``_got`` is what is there to take.
    used = (
        wanted.join(uses.withColumnRenamed("source", "_u"), F.col("source").eqNullSafe(F.col("_u")), "left")
        .groupBy("source", "source_size", "target")
        .agg(
            F.coalesce(F.sum(F.expr("uses * block_words")), F.lit(0)).alias("_all_used"),
            F.coalesce(F.sum(F.expr("uses * least(block_words, source_size - block * block_words)")), F.lit(0)).alias("_got"),
        )
    )
    missed = F.abs(F.col("target") - F.col("_got")) > F.col("target") * MISS_SHARE + MISS_WORDS
    none = (F.col("target") >= 1) & (F.col("_got") == 0)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = (
        used.withColumn("_all_words", F.sum("target").over(every))
        .withColumn("_block_words", _block_words("_all_words", slots))
        .withColumn("_words", F.round("target").cast("bigint"))
        .select(
            F.col("source").alias("_s"), "source_size", "target", "_block_words", "_all_used",
            (missed | none).alias("_settled"),
            F.when(F.col("source_size") > 0, F.expr("_words div source_size")).otherwise(0).alias("_whole"),
            F.when(F.col("source_size") > 0, F.expr("_words % source_size")).otherwise(0).alias("_rest"),
        )
    )
    # The first six hex digits of the digest choose the slice.
    fraction = F.conv(F.substring(digest, 1, 6), 16, 10).cast("double") / F.lit(float(1 << 24))
    placed = running_total(sized, [src], [F.col(digest), F.col("size")], F.col("size"), start, fraction)
    # One row per source, and at most one per slot: both are broadcast.
    placed = placed.join(F.broadcast(sources), F.col(src).eqNullSafe(F.col("_s")), "left")
    at = {"a": F.col(start), "b": F.col(start) + F.col("size")}
    block = {"a": F.expr(f"{start} div _block_words"), "b": F.expr(f"greatest({start} + size - 1, 0) div _block_words")}
    for side in at:
        uses_of = uses.select(
            F.col("source").alias(f"_s_{side}"), F.col("block").alias(f"_b_{side}"),
            F.col("uses").alias(f"_uses_{side}"), F.col("used_before").alias(f"_before_{side}"),
        )
        same = F.col(src).eqNullSafe(F.col(f"_s_{side}")) & (block[side] == F.col(f"_b_{side}"))
        placed = placed.join(F.broadcast(uses_of), same, "left")

    def used_upto(side: str) -> Column:
        inside = F.col(f"_uses_{side}") * (at[side] - block[side] * F.col("_block_words"))
        settled = F.col("_whole") * at[side] + F.least(at[side], F.col("_rest"))
        return F.when(F.col("_settled"), settled).otherwise(F.coalesce(F.col(f"_before_{side}") + inside, F.col("_all_used")))

    again = F.when(F.col(start) < F.col("_rest"), 1).otherwise(0)
    copies = F.when(F.col("_settled"), F.col("_whole") + again).otherwise(F.coalesce("_uses_a", F.lit(0)))

    some = F.col("size") > 0
    return placed.select(
        *carry, "size", "source_size", "target",
        F.when(some, used_upto("b") - used_upto("a")).otherwise(0).cast("bigint").alias("taken"),
        F.when(some, copies).otherwise(0).cast("int").alias("copies"),
    )
