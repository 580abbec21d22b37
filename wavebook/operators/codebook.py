"""Variable and value labels.

The codebook is a table (variable, code, label, ord); ``code`` is null in the
row that holds the label of the variable itself. Column metadata carries the
same labels but is lost by casts, joins and aggregates, so the table counts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wavebook.functions.text import clean_text, plain_number
from wavebook.operators.joins import one_per_key
from wavebook.session import literal_table

SCHEMA = pa.schema(
    [("variable", pa.string()), ("code", pa.string()), ("label", pa.string()), ("ord", pa.int32())]
)

WHOLE = ("byte", "short", "integer", "long")
FLOATING = ("float", "double")


def codebook(spark: SparkSession, values: dict[str, dict], variables: dict[str, str] = {}) -> DataFrame:
    """A codebook from value labels ``{variable: {code: label}}`` and variable labels."""
    rows = [(name, None, label, 0) for name, label in variables.items()]
    for name, labels in values.items():
        rows += [(name, str(code), label, i) for i, (code, label) in enumerate(labels.items(), 1)]
    return literal_table(spark, SCHEMA, rows)


def set_variable_labels(df: DataFrame, **labels: str) -> DataFrame:
    for name, label in labels.items():
        df = df.withMetadata(name, {**df.schema[name].metadata, "label": label})
    return df


def set_value_labels(df: DataFrame, **labels: dict) -> DataFrame:
    for name, values in labels.items():
        texts = [[str(code), label] for code, label in values.items()]
        df = df.withMetadata(
            name,
            {**df.schema[name].metadata, "codes": [c for c, _ in texts], "labels": [t for _, t in texts]},
        )
    return df


def from_metadata(df: DataFrame) -> DataFrame:
    """The codebook of a labelled frame, read from its schema."""
    rows = []
    for field in df.schema:
        if "label" in field.metadata:
            rows.append((field.name, None, field.metadata["label"], 0))
        pairs = zip(field.metadata.get("codes", []), field.metadata.get("labels", []))
        rows += [(field.name, code, label, i) for i, (code, label) in enumerate(pairs, 1)]
    return literal_table(df.sparkSession, SCHEMA, rows)


def _by_value(df: DataFrame, book: DataFrame, variable: str, value, into: str) -> DataFrame:
    """Join the codes of a variable as values of the column's own type.

    A code ``1`` or ``1.0`` meets 1 in a whole or a floating column. A code listed
    twice is an error; codes that are no value of the type meet nothing.
    """
    kind = df.schema[variable].dataType
    code = F.col("code").try_cast(kind)
    if kind.typeName() in WHOLE:
        number = F.col("code").try_cast("double")
        code = F.coalesce(code, F.when(F.floor(number) == number, number.try_cast(kind)))
    listed = book.where((F.col("variable") == variable) & F.col("code").isNotNull())
    values = listed.select(code.alias("_code"), value.alias(into)).where("_code is not null")
    values = one_per_key(values, ["_code"], f"the codebook of {variable}")
    return df.join(values, F.col(variable) == F.col("_code"), "left").drop("_code")


def decode(df: DataFrame, book: DataFrame, variable: str, into: str) -> DataFrame:
    """Add the label of a variable's code; a code without a label stays missing.

    ``unlabelled`` counts such codes.
    """
    return _by_value(df, book, variable, F.col("label"), into)


def position(df: DataFrame, book: DataFrame, variable: str, into: str, start: int = 0) -> DataFrame:
    """Add the position of a code among its levels, counted from ``start``."""
    return _by_value(df, book, variable, F.col("ord") - 1 + start, into)


def code_text(df: DataFrame, variable: str) -> Column:
    """The text of a code as the codebook writes it: a whole number without ``.0``."""
    return plain_number(F.col(variable), df.schema[variable].dataType.typeName())


def same_code(kinds: dict[str, str]) -> Column:
    """The code of a codebook row, numbers of numeric variables in their one form."""
    numeric = [name for name, kind in kinds.items() if kind in (*WHOLE, *FLOATING)]
    number = plain_number(F.col("code").try_cast("double"), "double")
    return F.when(F.col("variable").isin(numeric), F.coalesce(number, "code")).otherwise(F.col("code"))


def usage(df: DataFrame, variables: list[str]) -> DataFrame:
    """(variable, code, n): how often every code occurs, for all variables in one scan."""
    pairs = [F.struct(F.lit(v).alias("variable"), code_text(df, v).alias("code")) for v in variables]
    return (
        df.select(F.inline(F.array(*pairs)))
        .where("code is not null")
        .groupBy("variable", "code")
        .agg(F.count("*").alias("n"))
    )


def _with_kind(book: DataFrame, df: DataFrame, variables: list[str]) -> DataFrame:
    kinds = {v: df.schema[v].dataType.typeName() for v in variables}
    return book.withColumn("_code", same_code(kinds))


def unlabelled(df: DataFrame, book: DataFrame, variables: list[str]) -> DataFrame:
    """(variable, code, n) of codes that occur and have no label."""
    used = usage(df, variables).withColumnRenamed("code", "_code")
    listed = _with_kind(book.where("code is not null"), df, variables).select("variable", "_code")
    return used.join(listed, ["variable", "_code"], "left_anti").withColumnRenamed("_code", "code")


def drop_unused(book: DataFrame, df: DataFrame, variables: list[str]) -> DataFrame:
    """The codebook without value labels that no row uses; variable labels stay."""
    found = usage(df, variables).withColumnRenamed("code", "_code")
    used = _with_kind(book, df, variables).join(found, ["variable", "_code"], "left_semi")
    others = book.where(F.col("code").isNull() | ~F.col("variable").isin(variables))
    return used.select(*book.columns).unionAll(others)


def clean(book: DataFrame) -> DataFrame:
    """Repair every label: one pass over the codebook, never over the data."""
    return book.withColumn("label", clean_text(F.col("label")))
