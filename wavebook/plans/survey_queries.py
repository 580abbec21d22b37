"""Queries on answers, indicators, labels and country files, with their SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wavebook.functions import formats, text
from wavebook.operators import (
    aggregate, codebook, columns, inequality, joins, pick, predicates, recode, reshape,
)
from wavebook.plans import country_files, extracts, macro, standins, trust
from wavebook.plans.registry import Registry
from wavebook.plans.standins import (
    ANSWERS_SQL, INDICATORS_SQL, SPARSE_SQL, TRUST_SQL, UNEVEN_SQL,
)
from wavebook.session import literal_table, scratch_path
from wavebook.sources import exports, releases
from wavebook.sources.tables import table

registry = Registry()
query = registry.query

SERIES = {"A": "gini", "N": "s80s20", "R": "poverty"}
SERIES_SQL = """max(value) FILTER (WHERE series = 'A') AS gini,
  max(value) FILTER (WHERE series = 'N') AS s80s20,
  max(value) FILTER (WHERE series = 'R') AS poverty"""

PRIORITIES = {"1": "URGENT", "2": "HIGH", "3": "MEDIUM", "4": "NOT SPECIFIED", "5": "LOW"}
STATUSES = {"F": "Most people can be trusted", "O": "Can't be too careful"}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

ALIAS_SCHEMA = pa.schema([("source", pa.string()), ("from", pa.string()), ("to", pa.string())])
ALIASES = [
    ("trust", "NATION_0", "United Nations"),
    ("trust", "NATION_1", "United Nations"),
    ("indicators", "NATION_0", "Other Spelling"),
]
TRUST_NAMES = {"NATION_3": "Nation Three"}
INDICATOR_NAMES = {"NATION_3": "Nation Three", "NATION_4": "Nation Four"}


# ---- shares and means ---------------------------------------------------------------------


@query(TRUST_SQL)
def trust_by_country_wave(spark: SparkSession, folder: str) -> DataFrame:
    return trust.trust_by_source(standins.answer_counts(spark, folder), "times")


@query(f"""
  SELECT o_orderkey, country, source,
         round_even(avg(trust) OVER (PARTITION BY country, source) * 100, 2) AS trust_pct
  FROM ({ANSWERS_SQL})""")
def trust_window(spark, folder):
    rows = standins.answers(spark, folder).select("o_orderkey", "country", "source")
    shares = trust.trust_by_source(standins.answer_counts(spark, folder), "times")
    return aggregate.share_on_rows(rows, ["country", "source"], shares)


@query(f"""
  SELECT country, avg(value) FILTER (WHERE series = 'A') AS h20,
         avg(value) FILTER (WHERE series = 'N') AS l20,
         round(avg(value) FILTER (WHERE series = 'A') / avg(value) FILTER (WHERE series = 'N'), 6)
           AS s80s20
  FROM ({INDICATORS_SQL}) WHERE year BETWEEN 1999 AND 2001 GROUP BY country""",
    transform="SELECT country, round(h20, 6) AS h20, round(l20, 6) AS l20, s80s20 FROM")
def period_mean_ratio(spark, folder):
    rows = standins.indicators(spark, folder, 1999, 2001)
    means = aggregate.period_means(rows, ["country"], "series", "value", {"A": "h20", "N": "l20"})
    ratio = aggregate.guarded_ratio(F.col("h20"), F.col("l20"))
    return means.select(
        "country", F.round("h20", 6).alias("h20"), F.round("l20", 6).alias("l20"),
        F.round(ratio, 6).alias("s80s20"),
    )


@query("""
  WITH c AS (SELECT nullif(o_orderpriority, '3-MEDIUM') AS value, count(*) AS n
             FROM orders GROUP BY 1)
  SELECT value, n, round_even(n * 1e2 / sum(n) OVER (), 2) AS raw_pct,
         CASE WHEN value IS NOT NULL THEN round_even(
           n * 1e2 / sum(n) FILTER (WHERE value IS NOT NULL) OVER (), 2) END AS valid_pct,
         CASE WHEN value IS NOT NULL THEN round_even(
           sum(n) FILTER (WHERE value IS NOT NULL) OVER (ORDER BY value) * 1e2
           / sum(n) FILTER (WHERE value IS NOT NULL) OVER (), 2) END AS cum_pct
  FROM c""")
def frequency_table(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("priority")
    )
    return aggregate.frequency(orders, "priority")


@query("""
  SELECT DISTINCT substr(o_orderpriority, 1, 1) AS code, substr(o_orderpriority, 3) AS label,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS ord
  FROM orders WHERE year(o_orderdate) = 1995""")
def levels_in_use(spark, folder):
    orders = table(spark, folder, "orders")
    orders = orders.where(predicates.in_years(F.col("o_orderdate"), 1995, 1995))
    code = F.substring("o_orderpriority", 1, 1)
    return aggregate.levels_in_use(
        orders, code, F.substr("o_orderpriority", F.lit(3)), code.cast("int")
    )


# ---- picking one row, widening -------------------------------------------------------------


@query(f"""
  SELECT country, series, year, value FROM ({INDICATORS_SQL})
  QUALIFY row_number() OVER (PARTITION BY country, series ORDER BY year DESC) = 1""")
def latest_per_series(spark, folder):
    rows = standins.indicators(spark, folder)
    picked = pick.latest_per_key(rows, ["country", "series"], "year", [F.col("country_code")])
    return picked.select("country", "series", "year", "value")


RANKED = ["MACHINERY2", "HOUSEHOLD3", "BUILDING1"]


@query(f"""
  SELECT * FROM ({TRUST_SQL}) WHERE source IN ('MACHINERY2', 'HOUSEHOLD3', 'BUILDING1')
  QUALIFY row_number() OVER (PARTITION BY country ORDER BY
    CASE source WHEN 'MACHINERY2' THEN 1 WHEN 'HOUSEHOLD3' THEN 2 ELSE 3 END, year DESC) = 1""")
def priority_pick(spark, folder):
    return trust.ranked_trust(trust_by_country_wave(spark, folder), RANKED)


@query(f"""
  WITH near AS (
    SELECT * FROM ({SPARSE_SQL}) WHERE year IN (1995, 1997, 1998)
    QUALIFY row_number() OVER (
      PARTITION BY country, series ORDER BY abs(year - 1996), year DESC) = 1),
  wide AS (SELECT country, country_code, {SERIES_SQL} FROM near GROUP BY ALL)
  SELECT * FROM wide WHERE gini IS NOT NULL AND s80s20 IS NOT NULL AND poverty IS NOT NULL""")
def nearest_year_indicators(spark, folder):
    rows = standins.sparse_indicators(spark, folder, 1995, 1998)
    return trust.nearest_indicators(rows, SERIES, [1995, 1997, 1998], 1996)


LATEST_SQL = f"""
  SELECT country_code, country, year, {SERIES_SQL} FROM (
    SELECT * FROM ({UNEVEN_SQL})
    QUALIFY row_number() OVER (PARTITION BY country, series ORDER BY year DESC) = 1)
  GROUP BY country_code, country, year"""


@query(LATEST_SQL)
def pivot_measures(spark, folder):
    rows = standins.uneven_indicators(spark, folder)
    return trust.latest_indicators(rows, SERIES, {}, 9999, {})


@query(f"""
  SELECT country_code, country, max(gini) AS gini, max(s80s20) AS s80s20,
         max(poverty) AS poverty, max(year) AS year
  FROM ({LATEST_SQL}) GROUP BY country_code, country""")
def pivot_collapsed(spark, folder):
    rows = standins.uneven_indicators(spark, folder)
    return trust.latest_indicators(rows, SERIES, {}, 9999, {}, collapse_year=True)


@query(f"""
  WITH wide AS ({LATEST_SQL})
  SELECT * FROM (UNPIVOT wide ON gini, s80s20, poverty INTO NAME measure VALUE value)
  WHERE value IS NOT NULL""")
def pivot_lengthened(spark, folder):
    wide = pivot_measures(spark, folder)
    return reshape.lengthen(
        wide, ["country_code", "country", "year"], ["gini", "s80s20", "poverty"], "measure", "value"
    )


@query("""
  SELECT o_custkey, o_orderkey, o_totalprice FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def distinct_keep_first(spark, folder):
    orders = columns.without(table(spark, folder, "orders"), "o_orderstatus", "o_orderpriority")
    first = pick.first_per_key(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return first.drop("o_orderdate").select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"""
  WITH s AS (SELECT DISTINCT country, source,
               round_even(avg(trust) OVER (PARTITION BY country) * 100, 2) AS trust_pct,
               count(trust) OVER (PARTITION BY country) AS n_valid
             FROM ({ANSWERS_SQL}))
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY country ORDER BY source) = 1""")
def share_keep_first(spark, folder):
    counts = standins.answer_counts(spark, folder)
    first = trust.one_share_per_country(counts, ["source"], [F.col("source")], "times")
    return columns.without(first, "n_trusts")


# ---- joins ---------------------------------------------------------------------------------


@query(f"""
  WITH t AS (SELECT * FROM ({TRUST_SQL})
             QUALIFY row_number() OVER (PARTITION BY country ORDER BY year DESC, source) = 1),
  i AS (SELECT country, year, value FROM ({INDICATORS_SQL}) WHERE series = 'A'
        QUALIFY row_number() OVER (PARTITION BY country ORDER BY year DESC) = 1)
  SELECT t.country, t.trust_pct, i.value AS gini, t.source AS trust_source,
         t.year AS trust_year, i.year AS inequality_year
  FROM t JOIN i ON t.country = i.country""")
def inner_join_two_years(spark, folder):
    latest = trust.latest_trust(trust_by_country_wave(spark, folder), {})
    rows = standins.indicators(spark, folder).where("series = 'A'")
    gini = pick.latest_per_key(rows, ["country"], "year", [F.col("country_code")])
    both = joins.inner_pick(gini.select("country", "year", "value"), latest, "country")
    return columns.pick_renamed(
        both, country="country", trust_pct="trust_pct", gini="value", trust_source="source",
        trust_year="year_y", inequality_year="year_x",
    )


@query(f"""
  WITH t AS (SELECT * REPLACE (CASE country WHEN 'NATION_3' THEN 'Nation Three'
                                            ELSE country END AS country)
             FROM ({TRUST_SQL})
             QUALIFY row_number() OVER (PARTITION BY country ORDER BY year DESC, source) = 1),
  usable AS (SELECT * FROM ({UNEVEN_SQL})
             WHERE CASE WHEN country = 'NATION_2' THEN year <= 2000 ELSE year <= 1999 END),
  last AS (SELECT * FROM usable
           QUALIFY row_number() OVER (PARTITION BY country, series ORDER BY year DESC) = 1),
  i AS (SELECT CASE country WHEN 'NATION_3' THEN 'Nation Three' WHEN 'NATION_4' THEN 'Nation Four'
                            ELSE country END AS country,
               country_code, year, {SERIES_SQL}
        FROM last GROUP BY ALL)
  SELECT t.country, trust_pct, gini, s80s20, poverty, source AS trust_source,
         n_trusts AS trust_n_agrees, n_valid AS trust_n_total, t.year AS trust_year,
         i.year AS inequality_year
  FROM i JOIN t ON i.country = t.country""")
def trust_inequality(spark, folder):
    latest = trust.latest_trust(trust_by_country_wave(spark, folder), TRUST_NAMES)
    rows = standins.uneven_indicators(spark, folder, last=2000)
    measures = trust.latest_indicators(rows, SERIES, INDICATOR_NAMES, 1999, {"NATION_2": 2000})
    return trust.trust_inequality(latest, measures, ["gini", "s80s20", "poverty"])


@query(f"""
  WITH t AS (SELECT country, round_even(avg(trust) * 100, 2) AS trust_pct
             FROM ({ANSWERS_SQL}) GROUP BY country),
  s AS (SELECT n_name AS country, count(*) AS n_suppliers,
               max(s_acctbal) AS top_balance
        FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name),
  r AS (SELECT n_name AS country, r_name AS Region
        FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT t.country, trust_pct, n_suppliers, top_balance, Region
  FROM t LEFT JOIN s ON t.country = s.country LEFT JOIN r ON t.country = r.country""")
def left_merge_chain(spark, folder):
    shares = aggregate.answer_share(
        standins.answer_counts(spark, folder), ["country"], "trust", weight="times"
    ).select("country", "trust_pct")
    nation = table(spark, folder, "nation")
    per_nation = (
        table(spark, folder, "supplier")
        .groupBy("s_nationkey")
        .agg(F.count("*").alias("n"), F.max("s_acctbal").alias("top"))
    )
    suppliers = columns.rename_at(
        per_nation.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "n", "top"),
        {1: "country", 2: "n_suppliers", 3: "top_balance"},
    )
    regions = nation.join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_name").alias("country"), F.col("r_name").alias("Region"))
    return joins.left_merge([shares, suppliers, regions], "country")


@query("""
  SELECT c_custkey, 'N' || c_nationkey AS iso2,
         CASE WHEN c_nationkey < 23 THEN 'NAT' || c_nationkey END AS iso3
  FROM customer""")
def code_crosswalk(spark, folder):
    key = F.col("n_nationkey").cast("string")
    codes = (
        table(spark, folder, "nation")
        .where("n_nationkey < 23")
        .select(F.concat(F.lit("N"), key).alias("iso2"), F.concat(F.lit("NAT"), key).alias("iso3"))
    )
    people = table(spark, folder, "customer").select(
        "c_custkey", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("country_iso2")
    )
    walked = joins.crosswalk(people, codes, "country_iso2", "iso2", "iso3")
    return walked.withColumnRenamed("country_iso2", "iso2")


@query("""
  WITH l AS (SELECT DISTINCT n_name AS key FROM customer JOIN nation ON c_nationkey = n_nationkey),
  r AS (SELECT DISTINCT CASE n_name WHEN 'NATION_4' THEN 'Nation Four' ELSE n_name END AS key
        FROM supplier JOIN nation ON s_nationkey = n_nationkey)
  SELECT key, 'left only' AS side FROM l WHERE key NOT IN (SELECT key FROM r)
  UNION ALL SELECT key, 'right only' FROM r WHERE key NOT IN (SELECT key FROM l)""")
def unmatched_keys(spark, folder):
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    people = table(spark, folder, "customer")
    left = people.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    firms = table(spark, folder, "supplier")
    right = firms.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn(
        "country", recode.harmonise(F.col("country"), {"NATION_4": "Nation Four"})
    )
    return joins.unmatched(left, right, "country")


@query(f"""
  WITH t AS (SELECT country, round_even(avg(trust) * 100, 2) AS trust_pct
             FROM ({ANSWERS_SQL}) GROUP BY country),
  e AS (SELECT n_name AS country,
               CASE WHEN min(s_acctbal) < -900 THEN NULL ELSE max(s_acctbal) END AS GDP_pc,
               CAST(count(*) AS DOUBLE) AS pop_n
        FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name),
  c AS (SELECT n_name AS country, r_name AS Region
        FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT t.country, trust_pct, GDP_pc, pop_n, Region
  FROM t LEFT JOIN e ON t.country = e.country LEFT JOIN c ON t.country = c.country""")
def macro_merge(spark, folder):
    shares = aggregate.answer_share(
        standins.answer_counts(spark, folder), ["country"], "trust", weight="times"
    ).select("country", "trust_pct")
    nation = table(spark, folder, "nation")
    per_nation = table(spark, folder, "supplier").groupBy("s_nationkey").agg(
        F.max("s_acctbal").alias("top"), F.min("s_acctbal").alias("low"), F.count("*").alias("n")
    )
    top = F.when(F.col("low") < -900, "..").otherwise(F.col("top").cast("string"))
    blank = F.lit("..")
    extract = per_nation.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.lit(2019).alias("Time"), F.lit("YR").alias("Time Code"), F.col("n_name").alias("Country Name"),
        F.col("n_nationkey").alias("Country Code"), top.alias("GDP [x]"),
        F.col("n").cast("string").alias("Pop [x]"),
        *[blank.alias(f"{name} [x]") for name in ("Urban", "Top", "Bottom", "Ratio")],
    )
    classes = nation.join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_name").alias("Economy"), F.col("n_nationkey").alias("Code"), F.col("r_name").alias("Region"))
    merged = macro.merged(shares, macro.extract_table(extract), macro.class_table(classes, F.col("Code").isNotNull()))
    return columns.pick(merged, "country", "trust_pct", "GDP_pc", "pop_n", "Region")


# ---- recoding ------------------------------------------------------------------------------


@query("""
  SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 END AS trust_d,
         round_even(floor(o_totalprice) / 4, 1) AS even_price,
         floor(floor(o_totalprice) / 4 * 10 + 0.5) / 10 AS factor_price
  FROM orders""")
def recode_rules(spark, folder):
    quarter = F.floor("o_totalprice").cast("double") / 4
    return table(spark, folder, "orders").select(
        "o_orderkey",
        recode.recode(F.col("o_orderstatus"), {"O": 0, "F": 1}).alias("trust_d"),
        formats.round_half_even(quarter, 1).alias("even_price"),
        formats.round_by_factor(quarter, 1).alias("factor_price"),
    )


@query(f"""
  SELECT CASE WHEN country IN ('NATION_0', 'NATION_1') THEN 'United Nations' ELSE country END
           AS country,
         round_even(avg(trust) * 100, 2) AS trust_pct,
         count(*) FILTER (WHERE trust = 1) AS n_trusts, count(trust) AS n_valid
  FROM ({ANSWERS_SQL}) GROUP BY 1""")
def alias_harmonise(spark, folder):
    aliases = literal_table(spark, ALIAS_SCHEMA, ALIASES)
    nation = recode.harmonise_by(table(spark, folder, "nation"), "n_name", aliases, "trust")
    counts = standins.answer_counts(spark, folder, nation)
    return aggregate.answer_share(counts, ["country"], "trust", weight="times")


@query("""
  WITH a AS (SELECT o_orderkey, o_orderpriority,
               CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS DOUBLE) AS a1
             FROM orders)
  SELECT o_orderkey, a1 AS A1,
         CASE WHEN a1 IS NULL AND o_orderpriority = '1-URGENT' THEN 7777.0
              WHEN a1 IS NULL AND o_orderpriority = '2-HIGH' THEN 8888.0 ELSE a1 END AS A3,
         CASE WHEN a1 IS NULL AND o_orderpriority IN ('1-URGENT', '5-LOW') THEN 88.0
              ELSE a1 END AS A5
  FROM a""", transform="SELECT o_orderkey, A1, A3::DOUBLE AS A3, A5::DOUBLE AS A5 FROM")
def coded_missing(spark, folder):
    answer = recode.recode(F.col("o_orderstatus"), standins.ANSWER_CODES).cast("double")
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", answer.alias("ppltrst"))
    rows = columns.duplicate(rows, A1="ppltrst", A3="ppltrst", A5="ppltrst")
    priority = F.col("o_orderpriority")
    coded = columns.compute(
        rows,
        A3=recode.plant_missing(
            F.col("A3"), [(priority == "1-URGENT", 7777.0), (priority == "2-HIGH", 8888.0)]
        ),
        A5=recode.plant_missing(F.col("A5"), [(priority.isin("1-URGENT", "5-LOW"), 88.0)]),
    )
    return columns.pick(coded, "o_orderkey", columns.Span("A1", "A5"))


@query("""
  SELECT o_orderkey,
         coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 'EVS' WHEN '2-HIGH' THEN 'WVS'
                  ELSE 'ESS' END, 'NA')
         || coalesce(CASE o_orderstatus WHEN 'F' THEN '1' END,
                     CASE WHEN o_totalprice > 250000 THEN '2' END, 'NA') AS source
  FROM orders""")
def survey_source_key(spark, folder):
    survey = recode.recode(
        F.col("o_orderpriority"), {"1-URGENT": "EVS", "2-HIGH": "WVS"}, F.lit("ESS")
    )
    wave = recode.recode(F.col("o_orderstatus"), {"F": 1})
    other = F.when(F.col("o_totalprice") > 250000, 2)
    return table(spark, folder, "orders").select(
        "o_orderkey", text.paste(survey, F.coalesce(wave, other)).alias("source")
    )


@query("""
  SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS balance,
         CAST(c_nationkey AS DOUBLE) AS nation
  FROM customer""")
def cast_indicators(spark, folder):
    texts = table(spark, folder, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, "..").otherwise(F.col("c_acctbal").cast("string")).alias("balance"),
        F.col("c_nationkey").cast("string").alias("nation"),
    )
    return columns.across(texts, ["balance", "nation"], recode.to_number)


# ---- labels --------------------------------------------------------------------------------


@query("""
  SELECT o_orderkey, o_orderstatus,
         CASE o_orderstatus WHEN 'F' THEN 'Most people can be trusted'
                            WHEN 'O' THEN 'Can''t be too careful' END AS status_label,
         substr(o_orderpriority, 1, 1) AS priority, substr(o_orderpriority, 3) AS priority_label
  FROM orders""")
def labelled_scan(spark, folder):
    book = codebook.codebook(spark, {"o_orderstatus": STATUSES, "priority": PRIORITIES})
    rows = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("priority")
    )
    labelled = codebook.decode(rows, book, "o_orderstatus", "status_label")
    return codebook.decode(labelled, book, "priority", "priority_label")


@query("""
  SELECT c_custkey, n_name AS country,
         CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1
              WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS INTEGER) AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def code_to_label(spark, folder):
    nations = table(spark, folder, "nation").select(
        F.lit("c_nationkey").alias("variable"),
        F.col("n_nationkey").cast("string").alias("code"),
        F.col("n_name").alias("label"),
        F.col("n_nationkey").alias("ord"),
    )
    segments = codebook.codebook(spark, {"c_mktsegment": {s: s.title() for s in SEGMENTS}})
    rows = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    named = codebook.decode(rows, nations, "c_nationkey", "country")
    return codebook.position(named, segments, "c_mktsegment", "segment").select(
        "c_custkey", "country", "segment"
    )


@query("""
  WITH book(variable, code, label, ord) AS (VALUES
    ('status', CAST(NULL AS VARCHAR), 'Trust in people', 0),
    ('status', 'F', 'Most people can be trusted', 1), ('status', 'O', 'Can''t be too careful', 2),
    ('priority', NULL, 'Priority of the order', 0), ('priority', '1-URGENT', 'Urgent', 1),
    ('priority', '9-NEVER', 'Never', 2)),
  used AS (SELECT 'status' AS variable, o_orderstatus AS code, count(*) AS n FROM orders GROUP BY 2
           UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2)
  SELECT variable, code, label, CAST(ord AS INTEGER) AS ord, coalesce(n, 0) AS n
  FROM book LEFT JOIN used USING (variable, code)""", name="codebook")
def codebook_in_use(spark, folder):
    rows = _labelled_orders(spark, folder)
    book = codebook.from_metadata(rows)
    used = codebook.usage(rows, ["status", "priority"])
    return book.join(used, ["variable", "code"], "left").select(
        *book.columns, F.coalesce("n", F.lit(0)).alias("n")
    )


def _labelled_orders(spark, folder):
    rows = columns.pick_renamed(
        table(spark, folder, "orders"), status="o_orderstatus", priority="o_orderpriority"
    )
    rows = codebook.set_variable_labels(
        rows, status="Trust in people", priority="Priority of the order"
    )
    return codebook.set_value_labels(
        rows, status=STATUSES, priority={"1-URGENT": "Urgent", "9-NEVER": "Never"}
    )


@query("""
  SELECT * FROM (VALUES
    ('status', CAST(NULL AS VARCHAR), 'Trust in people', 0),
    ('status', 'F', 'Most people can be trusted', 1), ('status', 'O', 'Can''t be too careful', 2),
    ('priority', NULL, 'Priority of the order', 0), ('priority', '1-URGENT', 'Urgent', 1))
    book(variable, code, label, ord)
  WHERE code IS NULL OR code IN (SELECT o_orderstatus FROM orders)
     OR code IN (SELECT o_orderpriority FROM orders)""")
def drop_unused_labels(spark, folder):
    rows = _labelled_orders(spark, folder)
    return codebook.drop_unused(codebook.from_metadata(rows), rows, ["status", "priority"])


def clean_sql(value: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for broken, plain in text.BROKEN_SEQUENCES:
        value = f"replace({value}, {quote(broken)}, {quote(plain)})"
    for letter, form in text.long_forms():
        value = f"replace({value}, {quote(letter)}, {quote(form)})"
    old, new = text.ascii_table()
    value = f"translate({value}, {quote(old)}, {quote(new)})"
    value = rf"regexp_replace({value}, '([A-Za-z])[{text.COMBINING}]+', '\1', 'g')"
    return f"trim({value}, ' ' || chr(9) || chr(13) || chr(10))"


BROKEN_AROUND = ("Â´ ", " â€™Ã© “œuvre„ ")


@query(f"""
  SELECT doc_id, {clean_sql("CASE WHEN lang = 'fr' THEN 'Â´ ' || text || ' â€™Ã© “œuvre„ ' ELSE text END")}
    AS text
  FROM documents""")
def clean_text(spark, folder):
    before, after = BROKEN_AROUND
    broken = F.concat(F.lit(before), "text", F.lit(after))
    dirty = F.when(F.col("lang") == "fr", broken).otherwise(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", text.clean_text(dirty).alias("text"))


@query(f"""
  WITH book AS (
    SELECT 'part' AS variable, CAST(p_partkey AS VARCHAR) AS code, p_name AS name FROM part
    UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier
    UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name FROM nation)
  SELECT variable, code, {clean_sql("' Ã¢ ' || name || ' â€œÉlan‟ '")} AS label FROM book""")
def clean_codebook(spark, folder):
    def entries(name, key, label):
        return table(spark, folder, name).select(
            F.lit(name).alias("variable"),
            F.col(key).cast("string").alias("code"),
            F.concat(F.lit(" Ã¢ "), F.col(label), F.lit(" â€œÉlan‟ ")).alias("label"),
        )

    book = entries("part", "p_partkey", "p_name").unionAll(
        entries("supplier", "s_suppkey", "s_name")
    ).unionAll(entries("nation", "n_nationkey", "n_name"))
    return codebook.clean(book)


CODES = {1: "one", 2: "two", 3: "three", 25: "quarter hundred", 99: "nobody"}


@query("""
  WITH b(variable, code, label, ord) AS (VALUES
    ('whole', '1', 'one', 1), ('whole', '2', 'two', 2), ('whole', '3', 'three', 3), ('whole', '25', 'quarter hundred', 4),
    ('whole', '99', 'nobody', 5)),
  p AS (SELECT p_partkey, p_size FROM part)
  SELECT p_partkey, label AS whole_label, label AS double_label, label AS text_label,
         CAST(ord AS INTEGER) AS place
  FROM p LEFT JOIN b ON p_size = CAST(code AS INTEGER)""")
def codes_by_value(spark, folder):
    """The same codes as whole numbers, floating numbers and texts meet the same labels."""
    size = F.col("p_size")
    rows = table(spark, folder, "part").select(
        "p_partkey", size.alias("whole"), size.cast("double").alias("floating"), size.cast("string").alias("text")
    )
    book = codebook.codebook(spark, {
        "whole": {f"{code}.0": label for code, label in CODES.items()}, "floating": CODES, "text": CODES,
    })
    rows = codebook.decode(rows, book, "whole", "whole_label")
    rows = codebook.decode(rows, book, "floating", "double_label")
    rows = codebook.decode(rows, book, "text", "text_label")
    return codebook.position(rows, book, "floating", "place", start=1).drop("whole", "floating", "text")


@query("""
  SELECT v.variable, CAST(c.code AS VARCHAR) AS code, c.label, CAST(c.ord AS INTEGER) AS ord
  FROM (VALUES ('whole'), ('floating'), ('text')) v(variable),
       (VALUES (1, 'one', 1), (2, 'two', 2), (3, 'three', 3), (25, 'quarter hundred', 4), (99, 'nobody', 5)) c(code, label, ord)
  WHERE c.code IN (SELECT p_size FROM part)""")
def drop_unused_codes(spark, folder):
    size = F.col("p_size")
    rows = table(spark, folder, "part").select(
        size.alias("whole"), size.cast("double").alias("floating"), size.cast("string").alias("text")
    )
    names = ["whole", "floating", "text"]
    book = codebook.codebook(spark, {name: CODES for name in names})
    return codebook.drop_unused(book, rows, names)


# Broken or accented texts and what they are after repair.
REPAIRS = [
    ("Â´quoted Â", "'quoted '"), ("Ã¢ge", "age"), ("cafÃ©", "cafe"), ("donâ€™t", "don't"), ("  “œuvre„ ", '"oeuvre"'),
    ("Straße", "Strasse"), ("ÆØÅ æøå", "AEOA aeoa"), ("Łódź", "Lodz"), ("Ǆ ǆ", "DZ dz"), ("© ® ½", "(C) (R)  1/2"),
    ("ﬁn ﬂat eﬃ", "fin flat effi"), ("ＡＢｃ１", "ABc1"), ("ƀƗ Ⱥ", "bI A"), ("«a» …", "<<a>> ..."), ("Þór ðe", "THor de"),
    ("¿Qué? ¡Sí!", "?Que? !Si!"), ("plain text ", "plain text"), ("Việt Nam", "Viet Nam"),
]
REPAIRS_SQL = " ".join(f"WHEN {i} THEN '{clean.replace(chr(39), chr(39) * 2)}'" for i, (_, clean) in enumerate(REPAIRS))


@query(f"""
  SELECT c_custkey, c_name || ': ' || CASE c_custkey % {len(REPAIRS)} {REPAIRS_SQL} END AS text FROM customer""")
def clean_known_texts(spark, folder):
    """Repair of texts whose right form is written out, one for every customer."""
    chosen = F.element_at(
        F.array(*[F.lit(dirty) for dirty, _ in REPAIRS]), (F.col("c_custkey") % len(REPAIRS) + 1).cast("int")
    )
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", text.clean_text(chosen).alias("text"))
    return rows.select("c_custkey", F.concat("c_name", F.lit(": "), "text").alias("text"))


# ---- country files -------------------------------------------------------------------------

EXPORT_ROOT = "/files/"
CODE_SQL = "CASE n_nationkey WHEN 7 THEN 'GBR' ELSE 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') END"


def _survey(spark, folder) -> DataFrame:
    """Orders as a survey with country columns, all made by the country-file plan."""
    nation = table(spark, folder, "nation")
    book = nation.select(
        F.lit("c_nationkey").alias("variable"),
        F.col("n_nationkey").cast("string").alias("code"),
        F.concat("n_name", F.lit(" & <Isles>")).alias("label"),
        F.col("n_nationkey").alias("ord"),
    )
    two = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    codes = nation.select(
        two.alias("iso2"),
        F.when(F.col("n_nationkey") == 7, "GBR").otherwise(F.concat(F.lit("N"), two)).alias("iso3"),
    )
    orders = table(spark, folder, "orders").drop("o_orderdate", "o_orderpriority")
    rows = standins.with_customer(spark, folder, orders, "c_nationkey").withColumn(
        "c_abrv", F.lpad(F.col("c_nationkey").cast("string"), 2, "0")
    )
    survey = country_files.with_country(rows, book, codes, "c_nationkey", "c_abrv", "iso2")
    named = columns.pick_renamed(
        survey, v1="o_orderkey", v2="o_orderstatus", v3="o_totalprice", country_ord="c_nationkey",
        country="country", country_iso2="country_iso2", country_iso3="country_iso3",
    )
    wanted = columns.numbered("v", 1, range(2, 4), 2)
    return country_files.narrow(
        named, [*wanted, "country_ord", "country", "country_iso2", "country_iso3"]
    )


@query(f"""
  WITH c AS (SELECT DISTINCT {CODE_SQL} AS code, n_name || ' &amp; &lt;Isles&gt;' AS name,
                    n_nationkey AS ord
             FROM orders JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey),
  l AS (SELECT *, '<li><a class="dropdown-item" href="/files/ESS10/ess10_' || code || '.sav">'
                  || name || '</a></li>' AS item FROM c)
  SELECT CAST(-1 AS BIGINT) AS ord, '<!-- generated from ESS10/ess10.sav -->' AS line
  WHERE EXISTS (SELECT * FROM c)
  UNION ALL SELECT CAST(ord AS BIGINT),
    CASE WHEN code = 'GBR' THEN '<!-- ' || item || ' -->' ELSE item END FROM l""")
def split_export_manifest(spark, folder):
    path = scratch_path(spark, "country-files")
    return country_files.publish(_survey(spark, folder), path, "ESS10/ess10", EXPORT_ROOT, "country_ord")


@query(f"""
  SELECT {CODE_SQL} AS country_iso3, count(*) AS n, count(DISTINCT o_orderkey) AS n_people,
         max(o_totalprice) AS top
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1""")
def country_file_scan(spark, folder):
    path = scratch_path(spark, "country-files")
    survey = _survey(spark, folder)
    exports.split_export(survey, "country_iso3", path, "ESS10/ess10")
    files = spark.read.schema(survey.schema).parquet(path)
    return (
        files.groupBy("country_iso3")
        .agg(F.count("*").alias("n"), F.countDistinct("v1").alias("n_people"), F.max("v3").alias("top"))
    )


@query(f"""
  SELECT DISTINCT 'ess10_' || {CODE_SQL} || '.sav' AS file, true AS listed, true AS found
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def links_and_files(spark, folder):
    """Every link of the manifest with its file and every file with its link."""
    path = scratch_path(spark, "country-files")
    survey = _survey(spark, folder)
    exports.split_export(survey, "country_iso3", path, "ESS10/ess10")
    written = spark.read.schema(survey.schema).parquet(path)
    countries = exports.country_list(written, "country_iso3", "country", "country_ord")
    return exports.links_and_files(countries, "ESS10/ess10", EXPORT_ROOT, exports.written_files(spark, path))


RELEASED_SQL = f"""
  SELECT {CODE_SQL} AS code, count(*) AS n, count(DISTINCT o_orderkey) AS n_people, max(o_totalprice) AS top,
         bool_or(o_totalprice > 100000 AND n_nationkey < 5) AS again
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1"""


def _released_twice(spark, folder) -> tuple[DataFrame, str]:
    """The survey released without the dear orders of some countries, then whole, and where."""
    survey = _survey(spark, folder)
    path = scratch_path(spark, "releases")
    for part in (survey.where("not (v3 > 100000 and country_ord < 5)"), survey):
        releases.publish_release(part, path, "ESS10/ess10", "country_iso3", "country", "country_ord")
    return survey, path


@query(f"SELECT code, n, n_people, top FROM ({RELEASED_SQL})")
def release_scan(spark, folder):
    survey, path = _released_twice(spark, folder)
    return (
        releases.read_release(spark, path, survey.schema).groupBy(F.col("country_iso3").alias("code"))
        .agg(F.count("*").alias("n"), F.countDistinct("v1").alias("n_people"), F.max("v3").alias("top"))
    )


@query(f"SELECT 'ess10_' || code || '.sav' AS file, again FROM ({RELEASED_SQL})")
def release_files(spark, folder):
    """Which country files the second release wrote anew."""
    _, path = _released_twice(spark, folder)
    return releases.release(spark, path).select("file", F.col("run").startswith("1-").alias("again"))


# ---- whole jobs from files with the columns they are delivered with ------------------------------

TERRITORY_SQL = """CASE n_name WHEN 'NATION_0' THEN 'United Nations' WHEN 'NATION_1' THEN 'United Nations'
                   ELSE n_name END"""


@query(f"""
  WITH a AS (
    SELECT {TERRITORY_SQL} AS country, CAST(year(o_orderdate) AS INTEGER) AS year,
           CASE WHEN o_orderkey % 3 = 0 THEN 'EVS' ELSE 'WVS' END || substr(o_orderpriority, 1, 1) AS source,
           CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS trust
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderstatus <> 'P')
  SELECT DISTINCT country, source, year, round_even(avg(trust) OVER g * 100, 2) AS trust_pct,
         count(*) FILTER (WHERE trust = 1) OVER g AS n_trusts, count(trust) OVER g AS n_valid
  FROM a WINDOW g AS (PARTITION BY country, source)""")
def trust_from_microdata(spark, folder):
    """Trend-file rows (survey, wave or the other file's wave, country, year, answer) to shares."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    rows = standins.with_customer(spark, folder, orders, "c_nationkey").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    european = F.col("o_orderkey") % 3 == 0
    wave = F.substring("o_orderpriority", 1, 1)
    microdata = rows.select(
        F.when(european, "EVS").otherwise("WVS").alias("survey"),
        F.when(~european, wave).alias("wave"), F.when(european, wave).alias("wave_other"),
        F.col("n_name").alias("country"), F.year("o_orderdate").alias("year"),
        recode.recode(F.col("o_orderstatus"), standins.ANSWER_CODES).alias("answer"),
    )
    territories = {"NATION_0": "United Nations", "NATION_1": "United Nations"}
    return trust.trust_by_source(trust.answers_of(microdata, territories))


def _renamed_series(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Stand-in indicators under the series names of the delivered files."""
    return rows.withColumn("series", recode.recode(F.col("series"), names)).withColumn(
        "country_code", F.col("country_code").cast("string")
    )


@query(f"""
  SELECT country, CAST(country_code AS VARCHAR) AS country_code, avg(value) FILTER (WHERE series = 'A') AS h20_m,
         avg(value) FILTER (WHERE series = 'N') AS l20_m
  FROM ({INDICATORS_SQL}) WHERE year BETWEEN 1999 AND 2001 AND series IN ('A', 'N') GROUP BY ALL""",
    transform="SELECT country, country_code, round(h20_m, 6) AS h20_m, round(l20_m, 6) AS l20_m,"
    " round(h20_m / l20_m, 6) AS s80s20 FROM")
def income_shares(spark, folder):
    names = dict(zip(["A", "N"], macro.SHARE_SERIES))
    rows = _renamed_series(standins.indicators(spark, folder, *macro.SHARE_YEARS), names)
    ratio = macro.share_ratio(rows, countries=None)
    return ratio.select(
        "country", "country_code", *[F.round(c, 6).alias(c) for c in ("h20_m", "l20_m", "s80s20")]
    )


@query(f"""
  WITH near AS (
    SELECT * FROM ({SPARSE_SQL}) WHERE year IN (1995, 1996) AND series IN ('A', 'R')
    QUALIFY row_number() OVER (PARTITION BY country, series ORDER BY abs(year - 1996), year DESC) = 1),
  wide AS (SELECT country, CAST(country_code AS VARCHAR) AS country_code, max(value) FILTER (WHERE series = 'A') AS "gdp-pc-ppp",
                  max(value) FILTER (WHERE series = 'R') AS gini FROM near GROUP BY ALL)
  SELECT * FROM wide WHERE "gdp-pc-ppp" IS NOT NULL AND gini IS NOT NULL""")
def gdp_and_gini(spark, folder):
    names = dict(zip(["A", "R"], macro.GDP_SERIES))
    rows = standins.sparse_indicators(spark, folder, min(macro.GDP_YEARS), max(macro.GDP_YEARS))
    return macro.gdp_and_gini(_renamed_series(rows, names))


SAMPLE_SQL = ",\n         ".join(
    f"CASE WHEN o_orderkey % {n} = 0 THEN NULL ELSE CAST(o_orderkey % {n + 4} AS DOUBLE) END AS x{n}" for n in range(2, 14)
)


@query(f"""
  WITH s AS (SELECT o_orderkey + 50000 AS idno,
         {SAMPLE_SQL}
         FROM orders)
  SELECT idno, x2 AS "A1", x3 AS "A2",
         CASE WHEN x4 IS NULL AND idno = 71215 THEN 7777.0 WHEN x4 IS NULL AND idno = 80670 THEN 8888.0 ELSE x4 END::DOUBLE AS "A3",
         x5 - 1 AS "A4", CASE WHEN x6 IS NULL AND idno = 80670 THEN 88.0 ELSE x6 - 1 END::DOUBLE AS "A5",
         CASE WHEN x7 IS NULL AND idno = 72206 THEN 77.0 ELSE x7 - 1 END::DOUBLE AS "A6", x8 AS "B1", x9 - 1 AS "B26", x10 AS "C7",
         CASE WHEN x11 IS NULL AND idno = 80670 THEN 77.0 ELSE x11 END::DOUBLE AS "C12", x12 AS "C16", x13 AS "C32"
  FROM s WHERE idno IN (50378, 60555, 92713, 92730, 55709, 51138, 57305, 71215, 80670, 72206, 89194, 91883, 67396, 87715, 84528)""")
def questionnaire_sample(spark, folder):
    """Chosen respondents under questionnaire codes; answers are delivered as texts."""
    key = F.col("o_orderkey")
    answers = [
        F.when(key % n > 0, (key % (n + 4)).cast("string")).alias(name)
        for n, name in enumerate(extracts.SAMPLE_CODES.values(), 2)
    ]
    survey = table(spark, folder, "orders").select((key + 50000).alias("idno"), *answers)
    return extracts.questionnaire_sample(survey)


@query("""
  WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_extendedprice, l_discount,
                    20 + l_partkey % 70 AS agea, l_suppkey % 2 + 1 AS brncntr, l_partkey % 21 - 10 AS reform_years
             FROM lineitem)
  SELECT l_returnflag AS cntry, l_discount AS dweight, l_orderkey % 11 AS ppltrst, l_orderkey % 10 AS pplfair,
         l_orderkey % 9 AS pplhlp, l_quantity AS eduyrs25, l_orderkey % 2 AS paredu_a_high, l_extendedprice AS trustindex3,
         CAST(reform_years >= 0 AS INTEGER) AS reform1_7, l_linenumber AS reform_id_num, l_orderkey % 2 AS female, agea,
         l_orderkey % 3 AS fbrneur, l_orderkey % 4 AS mbrneur, l_orderkey % 5 AS fnotbrneur, l_orderkey % 6 AS mnotbrneur,
         nullif(l_orderkey % 7, 0) AS blgetmg_d, 2000 - agea AS yrbrn, l_linenumber AS essround
  FROM s WHERE agea BETWEEN 25 AND 80 AND brncntr = 1 AND reform_years BETWEEN -7 AND 7 AND l_orderkey % 7 <> 0""")
def reform_sample(spark, folder):
    """The model sample of a reform study, from rows with the study's column names."""
    key = F.col("l_orderkey")
    age, years = 20 + F.col("l_partkey") % 70, F.col("l_partkey") % 21 - 10
    survey = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("cntry"), F.col("l_discount").alias("dweight"), (key % 11).alias("ppltrst"),
        (key % 10).alias("pplfair"), (key % 9).alias("pplhlp"), F.col("l_quantity").alias("eduyrs25"),
        (key % 2).alias("paredu_a_high"), F.col("l_extendedprice").alias("trustindex3"),
        (years >= 0).cast("int").alias("reform1_7"), F.col("l_linenumber").alias("reform_id_num"), (key % 2).alias("female"),
        age.alias("agea"), (key % 3).alias("fbrneur"), (key % 4).alias("mbrneur"), (key % 5).alias("fnotbrneur"),
        (key % 6).alias("mnotbrneur"), F.nullif(key % 7, F.lit(0)).alias("blgetmg_d"), (2000 - age).alias("yrbrn"),
        F.col("l_linenumber").alias("essround"), (F.col("l_suppkey") % 2 + 1).alias("brncntr"), years.alias("reform_years"),
    )
    return extracts.reform_sample(survey)


# ---- inequality ----------------------------------------------------------------------------

INCOMES_SQL = "SELECT n_name AS country, c_custkey, c_acctbal + 1000 AS income FROM customer JOIN nation ON c_nationkey = n_nationkey"


def _incomes(spark, folder):
    return table(spark, folder, "customer").select(
        "c_nationkey", (F.col("c_acctbal") + 1000).alias("income")
    )


def _named(spark, folder, per_nation: DataFrame) -> DataFrame:
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    return per_nation.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


@query(f"""
  WITH p AS (SELECT *, ntile(5) OVER (PARTITION BY country ORDER BY income, c_custkey) AS part
             FROM ({INCOMES_SQL})),
  s AS (SELECT country, sum(income) AS total, sum(income) FILTER (WHERE part = 5) AS top,
               sum(income) FILTER (WHERE part = 1) AS bottom FROM p GROUP BY country)
  SELECT country, round(coalesce(top, 0) / nullif(total, 0), 6) AS top_share,
         round(bottom / nullif(total, 0), 6) AS bottom_share,
         round(coalesce(top, 0) / nullif(bottom, 0), 4) AS s80s20
  FROM s""")
def quintile_share(spark, folder):
    ratios = inequality.quintile_ratio(_incomes(spark, folder), ["c_nationkey"], "income")
    return _named(spark, folder, ratios).select(
        "country", F.round("top_share", 6).alias("top_share"),
        F.round("bottom_share", 6).alias("bottom_share"), F.round("s80s20", 4).alias("s80s20"),
    )


@query(f"""
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY income, c_custkey) AS i,
                    count(*) OVER (PARTITION BY country) AS n FROM ({INCOMES_SQL}))
  SELECT country, count(*) AS n,
         round(sum((2 * i - n - 1) * income) / (max(n) * sum(income)), 6) AS gini
  FROM r GROUP BY country""")
def gini_by_group(spark, folder):
    values = inequality.gini(_incomes(spark, folder), ["c_nationkey"], "income")
    return _named(spark, folder, values).select("country", "n", F.round("gini", 6).alias("gini"))


@query("""
  WITH t AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey)
  SELECT n_name AS country, count(*) AS n, round(corr(c_acctbal, spent), 6) AS corr
  FROM customer JOIN t ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_name""")
def indicator_corr(spark, folder):
    spent = table(spark, folder, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"))
    people = table(spark, folder, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"))
    values = inequality.correlation(people, ["c_nationkey"], "c_acctbal", "spent")
    return _named(spark, folder, values).select("country", "n", F.round("corr", 6).alias("corr"))
