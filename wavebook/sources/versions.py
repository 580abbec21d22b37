"""Numbered small tables: a list of files that count, each new list under the next number.

A list is one file that its commit renames into place, so it is there whole or not at all. One
writer at a time; readers take the newest list and are not disturbed by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wavebook.sources.files import discover


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the lists that are whole, in order."""
    number = F.regexp_extract("path", r"/version=(\d+)/[^/]+$", 1)
    found = discover(spark, path, "*.parquet").select(number.alias("number")).where("number <> ''").distinct()
    return sorted(int(r.number) for r in found.collect())


def put(df: DataFrame, path: str, number: int) -> None:
    """Write a list under a number that none has yet; remains of one that broke off go."""
    df.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={number}")


def get(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={number}")
