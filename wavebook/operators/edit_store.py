"""A stored table whose edits are stored beside it.

Rows are in files by a hash of their key. An edit writes its cells only, and a short list
of the columns and files it touches; reading lays the latest value of every cell over the
rows of the touched files and takes the other files as they are. Compaction writes
the touched files anew and leaves the rest alone. The lists are written last, so work
that broke off leaves the table as it was. One writer at a time. Files that a compaction
has replaced stay, for readers that still have them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wavebook.operators.patch import patch_cells
from wavebook.session import materialise
from wavebook.sources.versions import get, put, versions

OWN = ("_part", "_generation")
CELLS = "col string, value string, edit int"


def part_of(key: Column, files: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(files)).cast("int")


def create(df: DataFrame, key: str, path: str, files: int) -> None:
    """Store a table in about ``files`` files by the hash of a key column; a key may have many rows.

    Rows of a key stand together unless the key is much larger than the rest.
    """
    spark = df.sparkSession
    if versions(spark, f"{path}/bases"):
        raise ValueError(f"{path!r} has a table already")
    if taken := [c for c in df.columns if c.lower() in OWN]:
        raise ValueError(f"column {taken[0]!r} is the store's own")
    if key not in df.columns:
        raise ValueError(f"no column {key!r}")
    df.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
    settings = spark.range(1).select(F.lit(key).alias("key"), F.lit(files).alias("files"))
    settings.coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
    _write(df.withColumn("_part", part_of(F.col(key), files)), path, 0)
    parts = spark.range(files).select(F.col("id").cast("int").alias("part"))
    put(parts.withColumns({"generation": F.lit(0), "folded": F.lit(0)}), f"{path}/bases", 0)


def _write(rows: DataFrame, path: str, generation: int) -> None:
    # A part that is much larger than the others goes over several tasks and files.
    rows.hint("rebalance", "_part").write.mode("overwrite").partitionBy("_part").parquet(
        f"{path}/rows/_generation={generation}"
    )


class _Store:
    """What the newest lists of a store say."""

    def __init__(self, spark: SparkSession, path: str):
        settings = spark.read.parquet(f"{path}/settings").first()
        self.spark, self.path, self.key, self.files = spark, path, settings.key, settings.files
        self.schema = spark.read.parquet(f"{path}/columns").schema
        self.base = versions(spark, f"{path}/bases")[-1]
        # One row for each file, as many as the store was made with.
        listed = get(spark, f"{path}/bases", self.base).collect()
        self.generations = {r.part: r.generation for r in listed}
        self.folded = listed[0].folded
        self.logged = versions(spark, f"{path}/log")
        self.pending = [n for n in self.logged if n > self.folded]
        logs = [get(spark, f"{path}/log", n).first() for n in self.pending]
        self.columns = sorted({c for r in logs for c in r["columns"]})
        self.touched = sorted({p for r in logs for p in r["parts"]})

    def rows(self, parts: list[int]) -> DataFrame:
        """Rows of some parts with their part; other files are not read."""
        own = [T.StructField(n, T.IntegerType()) for n in ("_generation", "_part")]
        stored = self.spark.read.schema(T.StructType([*self.schema.fields, *own])).parquet(f"{self.path}/rows")
        by_generation: dict[int, list[int]] = {}
        for part in parts:
            by_generation.setdefault(self.generations[part], []).append(part)
        held = [(F.col("_generation") == g) & F.col("_part").isin(p) for g, p in by_generation.items()]
        return stored.where(reduce(Column.__or__, held, F.lit(False))).drop("_generation")

    def patched(self) -> DataFrame:
        """Rows of the touched parts under the latest value of every cell."""
        kind = self.schema[self.key].dataType.simpleString()
        folders = [f"{self.path}/edits/edit={n}" for n in self.pending]
        reader = self.spark.read.schema(f"row {kind}, {CELLS}").option("basePath", f"{self.path}/edits")
        latest = reader.parquet(*folders).groupBy("row", "col").agg(F.max_by("value", "edit").alias("value"))
        return patch_cells(self.rows(self.touched), self.key, latest, self.columns)


def edit(spark: SparkSession, path: str, edits: DataFrame, read_only: list[str] = ()) -> int:
    """Store an edit list (row, col, value) and give its number.

    Values arrive as text, as for ``patch_cells``. A column that is unknown, read-only or the key, two
    values for one cell, and text that is no value of the column's type are
    errors, and the table stays as it was. A row that the table does not have changes nothing.
    """
    store = _Store(spark, path)
    open_to_edits = [c for c in store.schema.names if c != store.key and c not in read_only]
    kind = store.schema[store.key].dataType
    cells = materialise(edits.select(F.col("row").cast(kind), "col", F.col("value").cast("string")))
    found = cells.agg(
        F.collect_set("col").alias("columns"),
        F.collect_set(part_of(F.col("row"), store.files)).alias("parts"),
        F.count_if(F.col("col").isNull()).alias("unnamed"),
    ).first()
    refused = sorted(set(found["columns"]) - set(open_to_edits))
    if refused or found.unnamed:
        raise ValueError(f"not editable: {', '.join(refused) or 'a cell without a column'}")
    if not cells.groupBy("row", "col").count().where("count > 1").isEmpty():
        raise ValueError("two values for one cell")
    wrong = [
        (F.col("col") == c) & F.col("value").isNotNull() & F.col("value").try_cast(store.schema[c].dataType).isNull()
        for c in found["columns"]
    ]
    bad = cells.where(reduce(Column.__or__, wrong, F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].value!r} is no value of column {bad[0].col!r}")
    number = max([store.folded, *store.logged]) + 1
    cells.write.mode("overwrite").parquet(f"{path}/edits/edit={number}")
    listed = spark.range(1).select(
        F.array(*map(F.lit, found["columns"])).cast("array<string>").alias("columns"),
        F.array(*map(F.lit, found["parts"])).cast("array<int>").alias("parts"),
    )
    put(listed, f"{path}/log", number)
    return number


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table with all edits that are whole."""
    store = _Store(spark, path)
    others = [p for p in store.generations if p not in set(store.touched)]
    out = store.rows(others)
    if store.touched:
        out = out.unionByName(store.patched())
    return out.drop("_part")


def compact(spark: SparkSession, path: str) -> list[int]:
    """Fold the stored edits into the files they touch, and give these files' numbers."""
    store = _Store(spark, path)
    if not store.pending:
        return []
    generation = store.base + 1
    if store.touched:
        _write(store.patched(), path, generation)
    listed = get(spark, f"{path}/bases", store.base).select(
        "part",
        F.when(F.col("part").isin(store.touched), generation).otherwise(F.col("generation")).alias("generation"),
        F.lit(store.pending[-1]).alias("folded"),
    )
    put(listed, f"{path}/bases", generation)
    return store.touched
