"""A table stored in an order once, so that every page of it is a short read.

The rows are range-partitioned by the order into files of a bounded number of rows, and a small
manifest says how many rows stand before each file. A page reads the files that hold it,
wherever it is; the number of pages is known without reading any row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wavebook.operators.ranking import number_rows
from wavebook.operators.view import Order, sort_columns
from wavebook.session import materialise

# Rows of a file, about; a page sorts one file's rows, or those of its neighbours.
ROWS_PER_FILE = 200_000

# Helper columns, of the numbering as well.
OWN = ("_range", "_nth", "_place", "_slice", "_offset")


def store_order(df: DataFrame, order: Order, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write a table in an order, for ``stored_page`` and ``stored_info``.

    The ranges come from a sample of all partitions and use every order column, so many equal
    values of the first one do not fill one file. The manifest is written last: without it
    there is no stored order, whatever rows are there already.
    """
    if not order:
        raise ValueError("a stored order needs an order")
    if taken := [c for c in df.columns if c.lower() in OWN]:
        raise ValueError(f"column {taken[0]!r} is the store's own")
    spark = df.sparkSession
    files = max(1, -(-df.count() // rows_per_file))
    placed = df.repartitionByRange(files, *sort_columns(order)).withColumn("_range", F.spark_partition_id())
    placed.write.partitionBy("_range").parquet(f"{path}/rows")
    # Only the folders' names and the files' row counts are read for this.
    counts = spark.read.schema(placed.schema).parquet(f"{path}/rows").groupBy("_range").agg(F.count("*").alias("rows"))
    # A row per file, so the window is as short as the list of files.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    manifest = counts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    listed = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(down).alias("descending")) for name, down in order])
    manifest.withColumn("order", listed).write.parquet(f"{path}/manifest")


def _total(manifest: DataFrame) -> int:
    return manifest.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def stored_info(spark: SparkSession, path: str, page_length: int) -> DataFrame:
    """(total, pages) of a stored table, from its manifest."""
    manifest = spark.read.parquet(f"{path}/manifest")
    total = F.coalesce(F.sum("rows"), F.lit(0))
    return manifest.agg(total.alias("total"), F.ceil(total / page_length).alias("pages"))


def stored_page(spark: SparkSession, path: str, number: int, length: int) -> DataFrame:
    """Page ``number`` of a stored table; a page out of range is an error, and so is an order
    that gives two rows one place on it."""
    start = (number - 1) * length
    manifest = spark.read.parquet(f"{path}/manifest")
    if number < 1 or start >= _total(manifest):
        raise ValueError("selected page is out of range")
    # The page with a row on either side, to see whether its ends share a place.
    low, high = max(start - 1, 0), start + length + 1
    held = manifest.where((F.col("before") < high) & (F.col("before") + F.col("rows") > low)).orderBy("before").collect()
    order = [(o.name, o.descending) for o in held[0].order]
    skipped = held[0].before
    near = spark.read.parquet(f"{path}/rows").where(F.col("_range").isin([r._range for r in held])).drop("_range")
    # Sorting the whole files would do; a short list of their first rows is less.
    window = near.orderBy(*sort_columns(order)).offset(low - skipped).limit(high - low)
    places = materialise(number_rows(window, sort_columns(order), "_nth"))
    names = [name for name, _ in order]
    if not places.groupBy(*names).count().where("count > 1").isEmpty():
        raise ValueError(f"the order {names} gives several rows the same place")
    first = start - low
    return places.where(F.col("_nth").between(first + 1, first + length)).drop("_nth")
