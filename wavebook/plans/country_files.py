"""From one labelled survey file to a folder per country and a list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wavebook.operators.codebook import decode
from wavebook.operators.columns import numbered, pick, to_front
from wavebook.operators.joins import crosswalk
from wavebook.operators.recode import TERRITORIES, TERRITORY_CODES, harmonise
from wavebook.sources.exports import country_list, links_and_files, manifest, split_export, written_files

# The numbered questions kept from each survey.
WVS_QUESTIONS = (
    6, 165, 171, 172, 173, 289, 49, 195, 262, 21, range(121, 131), range(201, 213), 69, 144, 145,
    166, range(112, 118), 284, 47, 50, 52, 56, range(64, 90), range(106, 112), range(131, 139),
    260, range(263, 266), range(273, 276), 277, 278, 279, 287, 288,
)
EVS_QUESTIONS = (
    6, 9, range(51, 57), 57, 63, 64, 39, 163, 198, 24, range(184, 189), 211, 58, 8,
    range(102, 108), 142, 143, 144, range(164, 169), 169, 170, 225, 227, 230, 232, 234, 237,
    "239_r", "243_r", 244, 249, 259, 260, 261, "261_ppp", "261_r",
)

COUNTRY_COLUMNS = ["country", "country_iso2", "country_iso3"]


def with_country(
    survey: DataFrame, book: DataFrame, codes: DataFrame, variable: str, alpha: str, given: str
) -> DataFrame:
    """Add country, country_iso2 and country_iso3 to a survey.

    ``variable`` is the coded country, ``alpha`` its letter code and ``given``
    says whether that is iso2 or iso3; the other code comes from the crosswalk.
    Territories become part of their country.
    """
    named = decode(survey, book, variable, "country")
    named = named.withColumn("country", harmonise(F.col("country"), TERRITORIES))
    named = named.withColumn(f"country_{given}", harmonise(F.col(alpha), TERRITORY_CODES))
    other = "iso2" if given == "iso3" else "iso3"
    walked = crosswalk(named, codes, f"country_{given}", given, other)
    return walked.withColumnRenamed(other, f"country_{other}")


def narrow(survey: DataFrame, variables: list[str]) -> DataFrame:
    """The chosen variables with the country columns first; a missing one is an error."""
    return to_front(pick(survey, *variables), "country")


def world_values(survey: DataFrame) -> DataFrame:
    """The numbered questions kept of the World Values Survey, behind the country columns."""
    return narrow(survey, [*numbered("Q", *WVS_QUESTIONS), *COUNTRY_COLUMNS])


def european_values(survey: DataFrame) -> DataFrame:
    """The numbered questions kept of the European Values Study, behind the country columns."""
    return narrow(survey, [*numbered("v", *EVS_QUESTIONS), *COUNTRY_COLUMNS])


def publish(survey: DataFrame, path: str, dataset: str, root: str, order: str) -> DataFrame:
    """Write every country and give the manifest, read back from what was written.

    A link without a file or a file without a link is an error.
    """
    spark = survey.sparkSession
    split_export(survey, "country_iso3", path, dataset)
    countries = country_list(spark.read.schema(survey.schema).parquet(path), "country_iso3", "country", order)
    both = links_and_files(countries, dataset, root, written_files(spark, path))
    apart = both.where("not (listed and found)").limit(5).collect()
    if apart:
        raise ValueError(f"links and files differ: {[row.file for row in apart]}")
    return manifest(countries, dataset, root)
