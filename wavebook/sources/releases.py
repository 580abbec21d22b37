"""Releases of the country files: a new one is written aside and switched to at once.

A release is a list of countries, each with the digest of its rows and the run that wrote its
file. A new release writes only the countries whose rows changed, compares what
it lists with the files that are there, and counts once its list is stored. Until then,
and if it breaks off, readers see the release before it, whole. Files of older releases stay.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wavebook.operators.quality import fingerprint
from wavebook.session import materialise
from wavebook.sources.exports import FILE, country_list, file_name, split_export
from wavebook.sources.files import discover
from wavebook.sources.versions import get, put, versions

RUN = "run"


def digests(survey: DataFrame, key: str, dataset: str) -> DataFrame:
    """(code, file, digest): what the rows of a country are, in whatever order they come.

    The number of rows, and the sum and the exclusive or of their two 64-bit hashes, after a
    hash of the columns' names and types; merged in each task before the shuffle.
    """
    kinds = F.sha2(F.lit(survey.schema.simpleString()), 256)
    hashed = survey.select(F.col(key).alias("code"), *fingerprint(survey.columns))
    content = hashed.groupBy("code").agg(
        F.count("*").alias("n"), F.sum(F.col("_a").cast("decimal(20,0)")).alias("sum"), F.bit_xor("_b").alias("xor")
    )
    lost = F.raise_error(F.lit(f"a row has no {key}, so no file"))
    return content.select(
        "code", F.coalesce(file_name(dataset, "code"), lost).alias(FILE), F.concat_ws(":", kinds, "n", "sum", "xor").alias("digest")
    )


def publish_release(survey: DataFrame, path: str, dataset: str, key: str, name: str, order: str) -> DataFrame:
    """Make a release of a survey below ``path`` and give its list.

    The list has (code, name, ord, file, digest, run). A row without a code is an error, as are columns
    named ``file`` or ``run``. Countries that are gone leave the list. A release without any change
    is a new list of the same files.
    """
    if taken := [c for c in survey.columns if c.lower() in (FILE, RUN)]:
        raise ValueError(f"column {taken[0]!r} is the release's own")
    spark = survey.sparkSession
    numbers = versions(spark, f"{path}/releases")
    number = numbers[-1] + 1 if numbers else 0
    now = digests(survey, key, dataset)
    # One row a country; a missing code stays, and is an error where its file is named.
    countries = country_list(survey, key, name, order)
    now = now.join(countries, "code", "left").select("code", "name", "ord", FILE, "digest")
    run = F.lit(None).cast("string").alias(RUN)
    before = get(spark, f"{path}/releases", numbers[-1]) if numbers else now.select(FILE, "digest", run)
    listed = materialise(now.join(before.select(FILE, "digest", RUN), [FILE, "digest"], "left"))
    own = f"{number}-{uuid.uuid4().hex[:12]}"
    changed = listed.where(F.col(RUN).isNull()).select(F.col("code").alias(key))
    if not changed.isEmpty():
        split_export(survey.join(changed, key, "left_semi"), key, f"{path}/files/{RUN}={own}", dataset)
    release = listed.withColumn(RUN, F.coalesce(RUN, F.lit(own))).select("code", "name", "ord", FILE, "digest", RUN)
    missing = release.join(stored_files(spark, path), [RUN, FILE], "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"links without files: {sorted(r[FILE] for r in missing)}")
    put(release, f"{path}/releases", number)
    return get(spark, f"{path}/releases", number)


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """(run, file): the country files of all runs."""
    found = discover(spark, f"{path}/files", "*.parquet")
    place = rf"/{RUN}=([^/]+)/{FILE}=([^/]+)/[^/]+$"
    parts = [F.url_decode(F.regexp_extract("path", place, i)).alias(n) for i, n in ((1, RUN), (2, FILE))]
    return found.select(*parts).distinct()


def release(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The list of a release, the newest by default."""
    numbers = versions(spark, f"{path}/releases")
    if not numbers or number not in (None, *numbers):
        raise ValueError(f"no release {number if number is not None else ''} below {path!r}")
    return get(spark, f"{path}/releases", numbers[-1] if number is None else number)


def read_release(spark: SparkSession, path: str, schema: T.StructType, number: int | None = None) -> DataFrame:
    """The rows of a release, the newest by default; only its own files are read."""
    by_run: dict[str, list[str]] = {}
    # One row a country.
    for r in release(spark, path, number).select(RUN, FILE).collect():
        by_run.setdefault(r[RUN], []).append(r[FILE])
    if not by_run:
        return spark.createDataFrame([], schema)
    own = [T.StructField(n, T.StringType()) for n in (RUN, FILE)]
    stored = spark.read.schema(T.StructType([*schema.fields, *own])).parquet(f"{path}/files")
    held = [(F.col(RUN) == run) & F.col(FILE).isin(files) for run, files in by_run.items()]
    return stored.where(reduce(Column.__or__, held)).drop(RUN, FILE)
