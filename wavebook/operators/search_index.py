"""Searches of a whole table through a stored index of trigrams.

Rows are stored in numbered blocks of a bounded size. For every three neighbouring characters of
a row's text the index has the rows of each block that hold them, sorted by trigram, so
a search reads the postings of its own trigrams only, intersects them block by block, and
looks at the rows that are left. These are confirmed by the plain search, so the result is
that of ``predicates.search_everywhere``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wavebook.functions.text import words_of
from wavebook.operators.predicates import cell_text, text_matches

# Rows of a block, about: a posting has no more entries.
ROWS_PER_BLOCK = 65_536

# Candidates in up to so many blocks are read by the blocks' names.
BLOCKS_LISTED = 1_000

SIZE = 3
OWN = ("_block", "_row")
POSTINGS = "trigram string, _block int, rows array<int>"
BLOCKS = "_block int, n bigint"


def row_text(df: DataFrame, names: list[str]) -> Column:
    """The text a search looks at: all cells as shown, with blanks between."""
    return F.concat_ws(" ", *[cell_text(df, name) for name in names])


def trigrams(query: str) -> list[str]:
    """The distinct trigrams of a query's words; shorter words have none."""
    return sorted({word[i : i + SIZE] for word in words_of(query) for i in range(len(word) - SIZE + 1)})


def build_index(df: DataFrame, path: str, rows_per_block: int = ROWS_PER_BLOCK) -> None:
    """Store a table with its index below ``path``, which must not exist."""
    if _read(df.sparkSession, f"{path}/blocks") is not None:
        raise ValueError(f"{path!r} has an index already; use append_to_index")
    if taken := [c for c in df.columns if c.lower() in OWN]:
        raise ValueError(f"column {taken[0]!r} is the index's own")
    # Rows go into folders by block, which an empty table does not have.
    df.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
    _add(df, path, 0, rows_per_block)


def append_to_index(df: DataFrame, path: str, rows_per_block: int = ROWS_PER_BLOCK) -> None:
    """Add rows to a stored table and its index; what is there is not written again."""
    spark = df.sparkSession
    stored, names = _stored(spark, path)
    if {c.lower() for c in df.columns} != {c.lower() for c in names}:
        raise ValueError(f"the index has columns {names}, not {df.columns}")
    # Blocks of an append that broke off are left alone, and so is their number.
    last = stored.agg(F.max("_block")).first()[0]
    same = [F.col(c).cast(stored.schema[c].dataType).alias(c) for c in names]
    _add(df.select(*same), path, 0 if last is None else last + 1, rows_per_block)


def _add(df: DataFrame, path: str, first: int, rows_per_block: int) -> None:
    """Write rows in new blocks, then their postings, then the list of blocks that counts them in."""
    spark, names = df.sparkSession, df.columns
    blocks = max(1, -(-df.count() // rows_per_block))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("int")
    numbered = df.repartition(blocks).withColumns({"_row": place, "_block": F.spark_partition_id() + first})
    numbered.write.mode("append").partitionBy("_block").parquet(f"{path}/rows")
    stored = _stored(spark, path)[0].where(F.col("_block") >= first)
    text = F.lower(row_text(stored, names))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(...))"), F.lit(1)))
    postings = (
        stored.select("_block", "_row", F.explode(found).alias("trigram"))
        .groupBy("trigram", "_block")
        # As many entries as a block has rows, at most.
        .agg(F.sort_array(F.collect_list("_row")).alias("rows"))
    )
    # A trigram that nearly every row has goes over several files, by block.
    ordered = postings.repartitionByRange("trigram", "_block").sortWithinPartitions("trigram", "_block")
    ordered.write.mode("append").parquet(f"{path}/postings")
    counted = stored.groupBy("_block").agg(F.count("*").alias("n"))
    counted.write.mode("append").parquet(f"{path}/blocks")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The stored rows, with their block and place, and the names of the table's own columns."""
    own = spark.read.parquet(f"{path}/columns").schema
    schema = T.StructType([*own.fields, T.StructField("_row", T.IntegerType()), T.StructField("_block", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{path}/rows"), own.names


def candidates(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """(_block, _row) of the rows that have every one of some trigrams."""
    postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings").where(F.col("trigram").isin(wanted))
    # A group is one block's postings of the query's trigrams.
    lists = postings.groupBy("_block").agg(F.collect_list("rows").alias("lists")).where(F.size("lists") == len(wanted))
    rest = F.slice(F.col("lists"), 2, len(wanted))
    common = F.aggregate(rest, F.col("lists")[0], lambda kept, other: F.array_intersect(kept, other))
    return lists.select("_block", F.explode(common).alias("_row"))


def search(
    spark: SparkSession, path: str, query: str, regex: bool = False, ignore_case: bool = True
) -> DataFrame:
    """Rows of a stored table that a search finds: the result of ``search_everywhere``.

    Words of three characters and more go through the index. A regular expression, or a
    query of shorter words only, looks at all rows, and so does a case-sensitive query
    beyond ASCII, whose small letters are not sure.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("_block")
    rows, names = _stored(spark, path)
    wanted = [] if regex or not (ignore_case or query.isascii()) else trigrams(query)
    if wanted:
        found = candidates(spark, path, wanted)
        held = [r._block for r in found.select("_block").distinct().limit(BLOCKS_LISTED + 1).collect()]
        if len(held) <= BLOCKS_LISTED:
            rows = rows.where(F.col("_block").isin(held))
        rows = rows.join(found, list(OWN), "left_semi")
    # Blocks that an append has not finished do not count.
    rows = rows.join(blocks, "_block", "left_semi")
    return rows.where(text_matches(row_text(rows, names), query, regex, ignore_case)).select(*names)
