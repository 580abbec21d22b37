"""Discovering, reading and writing files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from wavebook.functions.text import base_name

FORMATS = {"parquet": "parquet", "csv": "csv", "json": "json", "orc": "orc"}
DISCOVERED = "path string, file string, n_bytes bigint"


def discover(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, file, n_bytes) of files below ``folder`` matching ``glob``.

    The full path tells equal names in different folders apart and opens the file. A
    missing folder gives no rows. Only names and sizes are read: the content column
    is pruned.
    """
    try:
        found = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", glob)
            .load(folder)
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], DISCOVERED)
    return found.select(
        "path", base_name(F.col("path")).alias("file"), F.col("length").alias("n_bytes")
    )


def read_found(spark: SparkSession, found: DataFrame) -> dict[str, DataFrame]:
    """One frame per discovered file, by path, read by extension; the list of files is small."""
    return {row.path: spark.read.format(format_of(row.path)).load(row.path) for row in found.select("path").collect()}


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str,
    names: dict[str, str] | None = None,
    encoding: str = "UTF-8",
) -> DataFrame:
    """CSV with a header and a declared schema; awkward headers are renamed at once."""
    frame = (
        spark.read.schema(schema)
        .option("header", True)
        .option("encoding", encoding)
        .option("enforceSchema", False)
        .csv(path)
    )
    return frame.withColumnsRenamed(names or {})


def format_of(path: str) -> str:
    extension = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    if extension not in FORMATS:
        raise ValueError(f"no writer for {path!r}; use one of {sorted(FORMATS)}")
    return FORMATS[extension]


def write_table(
    df: DataFrame,
    path: str,
    codebook: DataFrame | None = None,
    compression: str | None = None,
    encoding: str | None = None,
    mode: str = "errorifexists",
) -> None:
    """Write by extension; labels go to a codebook table next to the data."""
    kind = format_of(path)
    writer = df.write.mode(mode).format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    if encoding:
        writer = writer.option("encoding", encoding)
    if compression:
        writer = writer.option("compression", compression)
    writer.save(path)
    if codebook is not None:
        codebook.write.mode(mode).parquet(f"{path.rstrip('/')}.codebook.parquet")


def read_table(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Read back what ``write_table`` wrote; ``labelled.read_labelled`` brings labels with it."""
    kind = format_of(path)
    reader = spark.read.schema(schema).format(kind)
    if kind == "csv":
        reader = reader.option("header", True)
    return reader.load(path)
