"""Survey-shaped frames made from the stand-in tables.

A respondent is an order, the country its customer's nation, the survey the
customer's market segment, the wave the first character of the priority and
the answer the order status: F is 1 (yes), O is 2 (no), P is missing. Long
indicators are mean quantities of line items per supplier nation, year and
return flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wavebook.operators.joins import sized_join
from wavebook.operators.predicates import in_years
from wavebook.operators.recode import recode, reverse_scale
from wavebook.plans.trust import TRUST_HIGHEST
from wavebook.sources.tables import table

ANSWER_CODES = {"F": 1, "O": 2}


def with_customer(spark: SparkSession, folder: str, orders: DataFrame, *names: str) -> DataFrame:
    """Orders with columns of their customer; a customer may have very many orders."""
    customer = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), *names)
    return sized_join(orders, customer, ["o_custkey"], "inner", reduced=False, nulls_match=False)


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per respondent."""
    orders = table(spark, folder, "orders").drop("o_totalprice")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    answer = recode(F.col("o_orderstatus"), ANSWER_CODES)
    return (
        with_customer(spark, folder, orders, "c_nationkey", "c_mktsegment")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "o_orderkey",
            F.col("n_name").alias("country"),
            F.concat("c_mktsegment", F.substring("o_orderpriority", 1, 1)).alias("source"),
            F.year("o_orderdate").alias("year"),
            answer.alias("answer"),
            reverse_scale(answer, TRUST_HIGHEST).alias("trust"),
        )
    )


def answer_counts(spark: SparkSession, folder: str, nation: DataFrame | None = None) -> DataFrame:
    """Respondents counted per country, source, year and answer, in column ``times``.

    Orders meet their customers by a sized join, at most one shuffle of four narrow
    columns that spreads hot customers; the counts after it are a few thousand rows.
    """
    orders = table(spark, folder, "orders").select(
        "o_custkey",
        F.substring("o_orderpriority", 1, 1).alias("wave"),
        F.year("o_orderdate").alias("year"),
        recode(F.col("o_orderstatus"), ANSWER_CODES).alias("answer"),
    )
    counted = (
        with_customer(spark, folder, orders, "c_nationkey", "c_mktsegment")
        .groupBy("c_nationkey", "c_mktsegment", "wave", "year", "answer")
        .agg(F.count("*").alias("times"))
    )
    nation = table(spark, folder, "nation") if nation is None else nation
    return counted.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("country"),
        F.concat("c_mktsegment", "wave").alias("source"),
        "year",
        reverse_scale(F.col("answer"), TRUST_HIGHEST).alias("trust"),
        "times",
    )


# Years the stand-in indicators can have, for a range with an open end.
FIRST_YEAR, LAST_YEAR = 1, 9998


def indicators(
    spark: SparkSession, folder: str, first: int = FIRST_YEAR, last: int = LAST_YEAR
) -> DataFrame:
    """(country, country_code, region, year, series, value), one row per observation.

    The span of years reaches the scan of the line items. They are summed per
    supplier first, so a supplier with very many of them is a few rows in the join.
    Quantities are whole, so sums are exact.
    """
    rows = table(spark, folder, "lineitem")
    if (first, last) != (FIRST_YEAR, LAST_YEAR):
        rows = rows.where(in_years(F.col("l_shipdate"), first, last))
    per_supplier = rows.groupBy(
        "l_suppkey", F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("series")
    ).agg(F.sum("l_quantity").alias("total"), F.count("*").alias("n"))
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    per_nation = (
        per_supplier.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", "year", "series")
        .agg((F.sum("total") / F.sum("n")).alias("value"))
    )
    nation = table(spark, folder, "nation")
    return per_nation.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("country"),
        F.col("n_nationkey").alias("country_code"),
        F.col("n_regionkey").alias("region"),
        "year",
        "series",
        "value",
    )


def uneven_indicators(spark: SparkSession, folder: str, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """The indicators with series R ending in 1998 in one region."""
    gone = (F.col("series") == "R") & (F.col("year") >= 1999) & (F.col("region") == 0)
    return indicators(spark, folder, first, last).where(~gone)


def sparse_indicators(spark: SparkSession, folder: str, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """The indicators without series R in one region."""
    return indicators(spark, folder, first, last).where(~((F.col("series") == "R") & (F.col("region") == 0)))


# The same frames in SQL, for checking.
ANSWERS_SQL = """
  SELECT o_orderkey, n_name AS country, c_mktsegment || substr(o_orderpriority, 1, 1) AS source,
         CAST(year(o_orderdate) AS INTEGER) AS year,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS answer,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS trust
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

INDICATORS_SQL = """
  SELECT n_name AS country, n_nationkey AS country_code, n_regionkey AS region,
         CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag AS series,
         sum(l_quantity) / count(*) AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY ALL"""

UNEVEN_SQL = f"""
  SELECT * FROM ({INDICATORS_SQL}) WHERE NOT (series = 'R' AND year >= 1999 AND region = 0)"""

SPARSE_SQL = f"""
  SELECT * FROM ({INDICATORS_SQL}) WHERE NOT (series = 'R' AND region = 0)"""

TRUST_SQL = f"""
  SELECT DISTINCT country, source, year,
         round_even(avg(trust) OVER g * 100, 2) AS trust_pct,
         count(*) FILTER (WHERE trust = 1) OVER g AS n_trusts,
         count(trust) OVER g AS n_valid
  FROM ({ANSWERS_SQL}) WINDOW g AS (PARTITION BY country, source)"""
