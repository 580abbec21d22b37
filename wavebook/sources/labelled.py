"""Tables whose labels survive a save.

Next to the data, in any format, stand two small Parquet tables: ``….columns.parquet`` with
the position, name and type of every column, and ``….codebook.parquet`` with the
labels. Reading puts both back, so a labelled frame comes back as it was saved, from a
format that keeps neither types nor labels as well.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wavebook.operators import codebook
from wavebook.session import literal_table
from wavebook.sources.files import read_table, write_table

COLUMNS = pa.schema([("place", pa.int32()), ("variable", pa.string()), ("kind", pa.string())])
BOOK = "variable string, code string, label string, ord int"

# A codebook up to this many rows is also put into the columns' metadata, which the driver holds.
LABELS_IN_SCHEMA = 100_000


def _beside(path: str, what: str) -> str:
    return f"{path.rstrip('/')}.{what}.parquet"


def write_labelled(
    df: DataFrame,
    path: str,
    book: DataFrame | None = None,
    compression: str | None = None,
    mode: str = "errorifexists",
) -> None:
    """Write a labelled frame by extension, its labels and types beside it.

    Labels come from ``book``, or else from the columns' metadata. Labels of columns that
    the frame does not have are an error, since nobody would find them again; so is a code
    listed twice. A frame without labels leaves an empty codebook, so that labels of an
    older save cannot be taken for its own. The data comes last: a save that broke
    off has labels and no data, never data with another table's labels.
    """
    book = codebook.from_metadata(df) if book is None else book
    strange = book.where(~F.col("variable").isin(df.columns)).select("variable").distinct().limit(5).collect()
    if strange:
        raise ValueError(f"labels of columns that are not there: {sorted(str(r.variable) for r in strange)}")
    twice = book.groupBy("variable", "code").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"the codebook lists a code twice: {sorted((r.variable, str(r.code)) for r in twice)}")
    kinds = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    literal_table(df.sparkSession, COLUMNS, kinds).coalesce(1).write.mode(mode).parquet(_beside(path, "columns"))
    book.select("variable", "code", "label", "ord").write.mode(mode).parquet(_beside(path, "codebook"))
    write_table(df, path, compression=compression, mode=mode)


def _found(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def saved_codebook(spark: SparkSession, path: str) -> DataFrame:
    """The codebook saved beside a table; without one, an empty codebook."""
    book = _found(spark, _beside(path, "codebook"))
    return spark.createDataFrame([], BOOK) if book is None else book


def saved_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The columns of a table as they were saved; None if nothing was saved beside it."""
    columns = _found(spark, _beside(path, "columns"))
    if columns is None:
        return None
    listed = columns.orderBy("place").collect()
    return T.StructType([T.StructField(r.variable, T.DataType.fromDDL(r.kind)) for r in listed])


def with_labels(df: DataFrame, book: DataFrame) -> DataFrame:
    """A frame with the labels of a codebook in its columns' metadata.

    The codebook is counted first; one beyond ``LABELS_IN_SCHEMA`` rows is an error, use
    the table itself (``codebook.decode``) then.
    """
    rows = book.where(F.col("variable").isin(df.columns)).orderBy("variable", "ord").limit(LABELS_IN_SCHEMA + 1).collect()
    if len(rows) > LABELS_IN_SCHEMA:
        raise ValueError(f"more than {LABELS_IN_SCHEMA} labels; join the codebook instead")
    named = {r.variable: r.label for r in rows if r.code is None}
    values: dict[str, dict] = {}
    for r in rows:
        if r.code is not None:
            values.setdefault(r.variable, {})[r.code] = r.label
    return codebook.set_value_labels(codebook.set_variable_labels(df, **named), **values)


def read_labelled(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Read back what ``write_labelled`` wrote: types, variable labels and value labels.

    ``schema`` is needed for a table that has nothing beside it, and wins over what
    was saved. ``codebook.from_metadata`` of the result is the codebook that was saved.
    """
    schema = saved_schema(spark, path) if schema is None else schema
    if schema is None:
        raise ValueError(f"{path!r} was saved without its columns; give a schema")
    return with_labels(read_table(spark, path, schema), saved_codebook(spark, path))
