"""One folder per country, and the list of links to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wavebook.functions.text import html_escape
from wavebook.sources.files import discover

# The layout of a manifest.
HEADER = "<!-- generated from %s.sav -->"
ITEM = '<li><a class="dropdown-item" href="%s">%s</a></li>'
HIDDEN = "<!-- %s -->"
HIDDEN_LINK = r"_GBR\.sav$"


# The partition column of an export; its value is the file name that a link ends in.
FILE = "file"


def file_name(dataset: str, code: str | Column) -> Column:
    """The one rule for the name of a country's file, in the export and in its link."""
    code = F.col(code) if isinstance(code, str) else code
    return F.concat(F.lit(f"{dataset.rsplit('/', 1)[-1]}_"), code, F.lit(".sav"))


def split_export(df: DataFrame, key: str, path: str, dataset: str) -> None:
    """Write every country in one job instead of one scan per country.

    A country's rows are in ``file=<its file name>``. A row without a code has no
    file and is an error. Rebalancing keeps a country's rows together but splits a
    country that is much larger than the rest over several tasks and files.
    """
    lost = F.raise_error(F.lit(f"a row has no {key}, so no file"))
    named = df.withColumn(FILE, F.coalesce(file_name(dataset, key), lost))
    named.hint("rebalance", FILE).write.partitionBy(FILE).parquet(path)


def written_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_parts): the country files found below a folder."""
    found = discover(spark, path, "*.parquet")
    name = F.url_decode(F.regexp_extract("path", f"/{FILE}=([^/]+)/[^/]+$", 1))
    return found.groupBy(name.alias(FILE)).agg(F.count("*").alias("n_parts"))


def links_and_files(countries: DataFrame, dataset: str, root: str, written: DataFrame) -> DataFrame:
    """(file, listed, found): every link and every file, and whether it has the other."""
    name = F.substring_index(link_of(dataset, root, F.col("code")), "/", -1)
    links = countries.select(name.alias(FILE), F.lit(True).alias("listed"))
    files = written.select(FILE, F.lit(True).alias("found"))
    both = links.join(files, FILE, "full").na.fill(False, ["listed", "found"])
    return both.select(FILE, "listed", "found")


def country_list(df: DataFrame, code: str, name: str, order: str) -> DataFrame:
    """One (code, name, ord) per code, code and name taken from the same row.

    Respondents are merged to distinct countries first.
    """
    names = df.where(F.col(code).isNotNull()).select(
        F.col(code).alias("code"), F.col(name).alias("name"), F.col(order).alias("ord")
    )
    first = F.min(F.struct("ord", "name"))
    return (
        names.distinct().groupBy("code").agg(first.alias("first")).select("code", "first.name", "first.ord")
    )


def link_of(dataset: str, root: str, code: str | Column) -> Column:
    folder = dataset.rpartition("/")[0]
    return F.concat(F.lit(f"{root}{folder}/" if folder else root), file_name(dataset, code))


def manifest(countries: DataFrame, dataset: str, root: str) -> DataFrame:
    """(ord, line): a header and one list item per country.

    A dataset without countries gives no lines at all, not even the header.
    """
    link = link_of(dataset, root, F.col("code"))
    item = F.format_string(ITEM, link, html_escape(F.col("name")))
    item = F.when(link.rlike(HIDDEN_LINK), F.format_string(HIDDEN, item)).otherwise(item)
    header = F.struct(F.lit(-1).cast("long").alias("ord"), F.lit(HEADER % dataset).alias("line"))
    entry = F.struct(F.col("ord").cast("long").alias("ord"), item.alias("line"))
    # Every country brings the header along, so no second look at the countries is needed.
    return countries.select(F.inline(F.array(header, entry))).distinct()


def manifest_name(dataset: str) -> str:
    return f"_{dataset.rsplit('/', 1)[-1]}-country-links.md"


def write_manifest(lines: DataFrame, path: str) -> None:
    """Ordered text. The line count is the number of countries, so one file is right."""
    lines.orderBy("ord").select("line").coalesce(1).write.text(path)
