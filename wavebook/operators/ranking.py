"""Row numbers and running totals without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wavebook.session import materialise

# monotonically_increasing_id: the slice above bit 33, the place in the slice below.
SLICE_BITS = 33

# Up to this many rows are cut from merged per-task top lists instead of being numbered.
SHALLOW_ROWS = 1_000


def number_rows(df: DataFrame, order: list[Column | str], name: str = "row_id") -> DataFrame:
    """1-based position of every row in a declared total order.

    The rows are range-sorted once and written with their place inside their
    slice; the sizes of the slices, one row each, give the offsets.
    """
    if not order:
        raise ValueError("numbering rows needs an order")
    placed = materialise(
        df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    )
    slice_ = F.shiftright("_place", SLICE_BITS).cast("int")
    sizes = placed.groupBy(slice_.alias("_slice")).agg(F.count("*").alias("_size"))
    # One row per task of the sort: bounded by the number of shuffle partitions.
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_slice", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = F.col("_place").bitwiseAND(F.lit((1 << SLICE_BITS) - 1))
    return (
        placed.withColumn("_slice", slice_)
        .join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.col("_offset") + inside + 1)
        .drop("_slice", "_place", "_offset")
    )


def first_rows(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of a declared order."""
    if not order:
        raise ValueError("a row cap needs an order")
    if n <= SHALLOW_ROWS:
        return df.orderBy(*order).limit(n)
    return number_rows(df, order, "_row").where(F.col("_row") <= n).drop("_row")


def running_totals(df: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """For each value column ``v``: ``v_before``, the sum over the rows of the same
    group that come earlier, and ``v_total``, the sum over the group.

    (group, order) must be unique; missing order values come first. A group of
    any size is spread over slices of the range order: sums inside a slice come
    from a window on (group, slice), sums of earlier slices from the slice totals.
    """
    # One struct per group: missing group values compare equal, also in the join.
    group = F.struct(*by) if by else F.lit(0)
    sliced = materialise(
        df.repartitionByRange(*by, order)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_group", group)
    )
    # At most one row per slice and group.
    totals = sliced.groupBy("_group", "_slice").agg(*[F.sum(v).alias(v) for v in values])
    whole = Window.partitionBy("_group")
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_group",
        "_slice",
        *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}_offset") for v in values],
        *[F.sum(v).over(whole).alias(f"{v}_total") for v in values],
    )
    inside = (
        Window.partitionBy("_group", "_slice")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = sliced.select(
        "*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_{v}_inside") for v in values]
    )
    return placed.join(offsets, ["_group", "_slice"]).select(
        *df.columns,
        *[(F.col(f"_{v}_offset") + F.col(f"_{v}_inside")).alias(f"{v}_before") for v in values],
        *[f"{v}_total" for v in values],
    )
