"""Queries on sources, columns, filters, key sets and displayed tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from wavebook.functions import formats
from wavebook.operators import codebook, columns, edit_store, joins, linked, patch, predicates, quality, ranking, reshape
from wavebook.operators import search_index, stored_order, view
from wavebook.plans.registry import Registry
from wavebook.plans.table_view import View
from wavebook.session import scratch_path
from wavebook.sources import files, labelled
from wavebook.sources.tables import SCHEMAS, table

registry = Registry()
query = registry.query


# ---- sources and sinks ---------------------------------------------------------------------


@query("SELECT c_custkey, c_name, 'Türkiye' AS place, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(spark, folder):
    path = scratch_path(spark, "customers") + ".csv"
    awkward = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("Customer Key"),
        F.col("c_name").alias("Name, full"),
        F.lit("Türkiye").alias("Reference area"),
        F.col("c_acctbal").alias("Balance (current US$)"),
        F.col("c_mktsegment").alias("segment-name"),
    )
    files.write_table(awkward, path, compression="bzip2", encoding="ISO-8859-1")
    schema = (
        "`Customer Key` bigint, `Name, full` string, `Reference area` string, "
        "`Balance (current US$)` double, `segment-name` string"
    )
    names = {
        "Customer Key": "c_custkey", "Name, full": "c_name", "Reference area": "place",
        "Balance (current US$)": "c_acctbal", "segment-name": "c_mktsegment",
    }
    return files.read_csv(spark, path, schema, names, "ISO-8859-1")


STATUS_LABELS = {"F": "Filled", "O": "Öpen, still", "P": 'Partly "filled"', "X": "never used"}


@query("""
  WITH kinds AS (SELECT unnest(['parquet', 'orc', 'json', 'csv']) AS kind),
  book(variable, code, label, ord) AS (VALUES
    ('o_orderstatus', NULL, 'State of the order', 0), ('o_orderstatus', 'F', 'Filled', 1), ('o_orderstatus', 'O', 'Öpen, still', 2),
    ('o_orderstatus', 'P', 'Partly "filled"', 3), ('o_orderstatus', 'X', 'never used', 4),
    ('rush', NULL, 'Asked for in haste', 0), ('rush', '1', 'yes', 1), ('rush', '2', 'no', 2), ('o_totalprice', NULL, 'Price, € ', 0)),
  codes AS (
    SELECT 'o_orderstatus' AS variable, o_orderstatus AS code, o_totalprice AS price FROM orders UNION ALL
    SELECT 'rush', CASE WHEN o_orderpriority LIKE '1%' THEN '1' ELSE '2' END, o_totalprice FROM orders),
  used AS (SELECT variable, code, count(*) AS n, max(price) AS most FROM codes GROUP BY ALL)
  SELECT kind, variable, code, label, CAST(ord AS INTEGER) AS ord, coalesce(n, 0) AS n, most,
         CASE variable WHEN 'o_orderstatus' THEN 'string' WHEN 'rush' THEN 'int' ELSE 'double' END AS type
  FROM kinds CROSS JOIN book LEFT JOIN used USING (variable, code)""")
def labels_after_reload(spark, folder):
    """Orders with labels, saved in four formats; labels, types and rows as they are read back."""
    rush = F.when(F.col("o_orderpriority").startswith("1"), 1).otherwise(2)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", rush.alias("rush"))
    orders = codebook.set_variable_labels(
        orders, o_orderstatus="State of the order", rush="Asked for in haste", o_totalprice="Price, € "
    )
    orders = codebook.set_value_labels(orders, o_orderstatus=STATUS_LABELS, rush={1: "yes", 2: "no"})
    base = scratch_path(spark, "labelled-orders")
    reports = []
    for kind, compression in (("parquet", "zstd"), ("orc", "zstd"), ("json", "gzip"), ("csv", "gzip")):
        path = f"{base}.{kind}"
        labelled.write_labelled(orders, path, compression=compression)
        back = labelled.read_labelled(spark, path)
        pairs = [
            F.struct(F.lit(v).alias("variable"), codebook.code_text(back, v).alias("code"), F.col("o_totalprice").alias("price"))
            for v in ("o_orderstatus", "rush")
        ]
        used = back.select(F.inline(F.array(*pairs))).groupBy("variable", "code").agg(F.count("*").alias("n"), F.max("price").alias("most"))
        types = F.create_map(*[F.lit(x) for f in back.schema for x in (f.name, f.dataType.simpleString())])
        reports.append(
            codebook.from_metadata(back).join(used, ["variable", "code"], "left").select(
                F.lit(kind).alias("kind"), "variable", "code", "label", "ord", F.coalesce("n", F.lit(0)).alias("n"), "most",
                types[F.col("variable")].alias("type"),
            )
        )
    return reduce(DataFrame.unionAll, reports)


@query("""
  SELECT kind, count(*) AS n, count(DISTINCT p_partkey) AS n_keys, max(p_name) AS last_name,
         max(p_retailprice) AS top_price
  FROM part, (VALUES ('parquet'), ('orc'), ('json'), ('csv')) f(kind) GROUP BY kind""")
def saved_table_reload(spark, folder):
    part = table(spark, folder, "part")
    base = scratch_path(spark, "parts")
    reports = []
    for kind, compression in (("parquet", "zstd"), ("orc", "zstd"), ("json", "bzip2"), ("csv", "bzip2")):
        path = f"{base}.{kind}"
        files.write_table(part, path, compression=compression)
        reports.append(
            files.read_table(spark, path, SCHEMAS["part"]).agg(
                F.lit(kind).alias("kind"), F.count("*").alias("n"),
                F.countDistinct("p_partkey").alias("n_keys"), F.max("p_name").alias("last_name"),
                F.max("p_retailprice").alias("top_price"),
            )
        )
    first, *rest = reports
    for report in rest:
        first = first.unionAll(report)
    return first


@query("SELECT p_partkey, p_name, p_type FROM part ORDER BY p_partkey LIMIT 220")
def row_capped_scan(spark, folder):
    part = columns.pick(table(spark, folder, "part"), 1, 2, 4)
    return ranking.first_rows(part, ["p_partkey"], 220)


@query("\n  UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n_rows FROM {name}" for name in SCHEMAS))
def discover_files(spark, folder):
    """Rows of every table, counted in the files that were discovered."""
    found = files.discover(spark, folder, "*.parquet")
    counts = [
        frame.agg(F.lit(path).alias("path"), F.count("*").alias("n"))
        for path, frame in files.read_found(spark, found).items()
    ]
    first, *rest = counts
    for count in rest:
        first = first.unionAll(count)
    name = F.regexp_extract("path", r"/([^/]+)\.parquet(?:/[^/]*)?$", 1)
    return first.groupBy(name.alias("name")).agg(F.sum("n").alias("n_rows"))


# ---- columns -------------------------------------------------------------------------------


@query("""
  SELECT l_orderkey AS V1, l_quantity AS V5, l_extendedprice AS V6, l_discount AS V7,
         l_partkey AS V2, l_returnflag AS V9, l_linestatus AS V10
  FROM lineitem""")
def select_expanded(spark, folder):
    rows = table(spark, folder, "lineitem")
    rows = columns.rename_at(rows, {i: f"V{i}" for i in range(1, len(rows.columns) + 1)})
    names = columns.numbered("V", 1, range(5, 8), 6, 2)
    return columns.pick(rows, *names, 1, columns.Span("V9", "V10"))


@query("SELECT c_nationkey, c_name, c_custkey, c_mktsegment FROM customer")
def relocate_prefix(spark, folder):
    rows = columns.to_front(table(spark, folder, "customer"), "c_n")
    shown = columns.visible(rows, rows.columns, hide=["c_acctbal"])
    rows = columns.pick(rows, *shown)
    return columns.reorder(rows, [2, 1, 3, 4])


# ---- filters -------------------------------------------------------------------------------


@query("""
  SELECT o_orderkey, o_totalprice FROM orders
  WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def string_predicate(spark, folder):
    rows = table(spark, folder, "orders").where(F.col("o_orderstatus") == "F")
    return columns.pick(
        predicates.matching(rows, "o_orderpriority = '1-URGENT'"), "o_orderkey", "o_totalprice"
    )


@query("""
  SELECT l_orderkey, l_partkey, l_quantity, l_discount FROM lineitem
  WHERE l_quantity BETWEEN 25 AND 40 AND l_discount <= 0.05 AND l_returnflag = 'N'""")
def model_sample(spark, folder):
    conditions = [
        F.col("l_quantity").between(25, 40), F.col("l_discount") <= 0.05, F.col("l_returnflag") == "N",
    ]
    rows = table(spark, folder, "lineitem").where(predicates.all_of(conditions))
    return columns.pick(rows, "l_orderkey", "l_partkey", "l_quantity", "l_discount")


@query("""
  SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, c_nationkey, c_acctbal
  FROM customer
  WHERE c_mktsegment <> 'BUILDING' AND c_nationkey <= CASE c_mktsegment
    WHEN 'MACHINERY' THEN 16 ELSE 13 END""")
def conditional_cutoff(spark, folder):
    rows = table(spark, folder, "customer").select(
        "c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"),
        "c_nationkey", "c_acctbal",
    )
    return rows.where(
        predicates.until(F.col("c_nationkey"), F.col("segment"), 13, {"MACHINERY": 16})
    )


@query("""
  SELECT o_orderkey, o_custkey FROM orders
  WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND year(o_orderdate) BETWEEN 1999 AND 2001
    AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def membership_filter(spark, folder):
    rows = table(spark, folder, "orders").where(
        F.col("o_orderpriority").isin("1-URGENT", "5-LOW")
        & predicates.in_years(F.col("o_orderdate"), 1999, 2001)
    )
    rich = table(spark, folder, "customer").where("c_acctbal > 5000")
    kept = joins.keep_keys(rows, rich.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    return kept.select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderstatus AS answer FROM orders WHERE o_orderstatus <> 'P'")
def drop_missing_rows(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("answer")
    )
    return predicates.drop_missing(rows, ["answer", "not_there"], strict=False)


@query("""
  SELECT event_id, event_type, value FROM events
  WHERE value BETWEEN 5 AND 60 AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20'
    AND event_type IN ('click', 'error')
    AND coalesce(CAST(CASE WHEN value > 50 THEN NULL ELSE value > 20 END AS VARCHAR), 'na')
        IN ('true', 'na')""")
def column_filters(spark, folder):
    flag = F.when(F.col("value") > 50, F.lit(None)).otherwise(F.col("value") > 20)
    conditions = [
        predicates.in_range(F.col("value"), 5, 60),
        predicates.in_range(F.col("event_id"), 0, None, domain=(0, 1e18)),
        predicates.in_period(F.col("ts"), "2024-01-03", "2024-01-20"),
        predicates.one_of(F.col("event_type"), ["click", "error"]),
        predicates.one_of(F.col("props"), []),
        predicates.flag_in(flag, ["true", "na"]),
    ]
    rows = table(spark, folder, "events").where(predicates.all_of(conditions))
    return rows.select("event_id", "event_type", "value")


ROW_TEXT_SQL = """lower(concat_ws(' ', CAST(p_partkey AS VARCHAR), p_name, p_brand, p_type,
  CAST(p_size AS VARCHAR), regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.0$', '')))"""


@query(f"""
  SELECT p_partkey, p_name, p_type FROM part
  WHERE contains({ROW_TEXT_SQL}, 'red') AND contains({ROW_TEXT_SQL}, 'econ')""")
def global_search(spark, folder):
    rows = predicates.search_everywhere(table(spark, folder, "part"), "  Red ECON ")
    return rows.select("p_partkey", "p_name", "p_type")


@query(f"""
  WITH words AS (SELECT unnest(['  Red ECON ', '#33', 'antique', 'zzz', 'a']) AS query),
  rows AS (SELECT p_partkey, p_name, {ROW_TEXT_SQL} AS text FROM part)
  SELECT query, p_partkey, p_name FROM rows, words
  WHERE CASE query WHEN '  Red ECON ' THEN contains(text, 'red') AND contains(text, 'econ') ELSE contains(text, query) END""")
def indexed_search(spark, folder):
    """Several searches of parts through one stored index, a third of the parts appended to it later."""
    parts, path = table(spark, folder, "part"), scratch_path(spark, "part-index")
    search_index.build_index(parts.where("p_partkey % 3 <> 0"), path)
    search_index.append_to_index(parts.where("p_partkey % 3 = 0"), path)
    found = [
        search_index.search(spark, path, words).select(F.lit(words).alias("query"), "p_partkey", "p_name")
        for words in ("  Red ECON ", "#33", "antique", "zzz", "a")
    ]
    return reduce(DataFrame.unionAll, found)


@query("SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '(?i)^brand#1\\d$')")
def regex_search(spark, folder):
    rows = predicates.search_column(table(spark, folder, "part"), "p_brand", r"^brand#1\d$", regex=True)
    return rows.select("p_partkey", "p_brand")


@query("""
  SELECT doc_id, lang FROM documents
  WHERE contains(lower(text), 'the') AND contains(lower(text), 'ing')""")
def text_search(spark, folder):
    rows = predicates.search_column(table(spark, folder, "documents"), "text", "THE ing")
    return rows.select("doc_id", "lang")


@query("""
  SELECT 'c_acctbal' AS column, min(c_acctbal) AS low, max(c_acctbal) AS high,
         CAST(NULL AS VARCHAR) AS option FROM customer
  UNION ALL SELECT 'c_custkey', CAST(min(c_custkey) AS DOUBLE), CAST(max(c_custkey) AS DOUBLE), NULL
  FROM customer
  UNION ALL SELECT DISTINCT 'c_mktsegment', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), c_mktsegment
  FROM customer
  UNION ALL SELECT DISTINCT 'c_nationkey', NULL, NULL, CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'ts', CAST(epoch_us(min(ts)) // 1000 AS DOUBLE), CAST(epoch_us(max(ts)) // 1000 AS DOUBLE), NULL FROM events
  UNION ALL SELECT 'day', CAST(epoch_ms(min(ts)::DATE) AS DOUBLE), CAST(epoch_ms(max(ts)::DATE) AS DOUBLE), NULL
  FROM events""")
def filter_domains(spark, folder):
    people = predicates.domains(
        table(spark, folder, "customer"), ["c_acctbal", "c_custkey"], ["c_mktsegment", "c_nationkey"]
    )
    events = table(spark, folder, "events").select("ts", F.to_date("ts").alias("day"))
    return people.unionAll(predicates.domains(events, ["ts", "day"], []))


PLAIN_SQL = """SELECT o_orderkey, CAST(o_orderkey * 1000003 AS VARCHAR) AS big,
           rtrim(format('{:.7f}', o_orderkey / 1e6), '0') AS small FROM orders"""


@query(f"""
  SELECT o_orderkey FROM (SELECT o_orderkey, big, rtrim(small, '.') AS small FROM ({PLAIN_SQL}))
  WHERE contains(o_orderkey || ' ' || big || ' ' || small, '00012')
    AND contains(o_orderkey || ' ' || big || ' ' || small, '3')""")
def number_search(spark, folder):
    """Words found in numbers above ten million and below a thousandth."""
    key = F.col("o_orderkey").cast("double")
    rows = table(spark, folder, "orders").select(
        "o_orderkey", (key * 1000003).alias("big"), (key / 1e6).alias("small")
    )
    return predicates.search_everywhere(rows, "00012 3").select("o_orderkey")


# ---- key sets ------------------------------------------------------------------------------


@query("""
  SELECT c_custkey, c_name, c_custkey IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2001)
    AS ordered
  FROM customer""")
def semi_anti_keys(spark, folder):
    people = table(spark, folder, "customer").select("c_custkey", "c_name")
    keys = table(spark, folder, "orders").where(predicates.in_years(F.col("o_orderdate"), 2001, 2001)).select(
        F.col("o_custkey").alias("c_custkey")
    )
    allowed = joins.keep_keys(people, keys, "c_custkey").withColumn("ordered", F.lit(True))
    denied = joins.drop_keys(people, keys, "c_custkey").withColumn("ordered", F.lit(False))
    return allowed.unionByName(denied)


LINKED_SQL = """
  SELECT c_custkey FROM customer
  WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND c_acctbal BETWEEN 0 AND 7000
    AND c_custkey IN (SELECT o_custkey FROM orders
                      WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1996-01-01' AND '1999-12-31')
    AND c_custkey IN (SELECT user_id FROM events
                      WHERE epoch(ts) BETWEEN 1704067200 AND 1705500000)"""


def _links(spark, folder, unique: bool = True) -> dict[str, DataFrame | None]:
    people = table(spark, folder, "customer")
    orders = table(spark, folder, "orders")
    events = table(spark, folder, "events")
    ticked = ["BUILDING", "MACHINERY", "FURNITURE"]
    return {
        "segment": linked.option_keys(people, "c_mktsegment", "c_custkey", ticked, unique),
        "nation": linked.option_keys(people, "c_nationkey", "c_custkey", [], unique),
        "balance": linked.slider_keys(people, "c_custkey", F.col("c_acctbal"), 0, 7000, unique=unique),
        "ordered": linked.slider_keys(
            orders, "o_custkey", F.col("o_orderdate"), "1996-01-01", "1999-12-31", "date", unique
        ),
        "active": linked.slider_keys(
            events, "user_id", F.col("ts"), 1704067200, 1705500000, "datetime", unique
        ),
    }


@query(f"SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey IN ({LINKED_SQL})")
def linked_filters(spark, folder):
    people = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    return linked.keep_linked(people, "c_custkey", _links(spark, folder, unique=False))


@query(f"SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey IN ({LINKED_SQL})")
def linked_filters_by_text(spark, folder):
    """The same filters over keys that are texts, which cannot be packed."""
    people = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    texts = {
        name: None if keys is None else keys.select(F.col("key").cast("string").alias("key"))
        for name, keys in _links(spark, folder).items()
    }
    named = people.withColumn("text_key", F.col("c_custkey").cast("string"))
    return linked.keep_linked(named, "text_key", texts).drop("text_key")


@query(f"SELECT c_custkey AS key FROM ({LINKED_SQL})")
def linked_key_set(spark, folder):
    return linked.intersect(_links(spark, folder))


@query("""
  SELECT c_custkey, c_name FROM customer
  WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')""")
def cleared_filters(spark, folder):
    links = _links(spark, folder)
    for name in ("balance", "ordered", "active"):
        links = linked.clear(links, name)
    people = table(spark, folder, "customer").select("c_custkey", "c_name")
    return linked.apply(people, "c_custkey", linked.intersect(links))


def _ordering_in(spark, folder, year: int) -> DataFrame:
    orders = table(spark, folder, "orders")
    orders = orders.where(predicates.in_years(F.col("o_orderdate"), year, year))
    return orders.select(F.col("o_custkey").alias("key")).distinct()


@query("""
  WITH a AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE year(o_orderdate) = 1998),
  b AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE year(o_orderdate) = 1999)
  SELECT key, 'removed' AS change FROM a WHERE key NOT IN (SELECT key FROM b)
  UNION ALL SELECT key, 'added' FROM b WHERE key NOT IN (SELECT key FROM a)""")
def key_set_changes(spark, folder):
    return linked.changes(_ordering_in(spark, folder, 1998), _ordering_in(spark, folder, 1999))


@query("SELECT DISTINCT o_custkey AS key FROM orders WHERE year(o_orderdate) IN (1998, 1999)")
def persistent_selection(spark, folder):
    return linked.select(
        _ordering_in(spark, folder, 1998), _ordering_in(spark, folder, 1999), persistent=True
    )


# ---- edits ---------------------------------------------------------------------------------


@query("""
  SELECT c_custkey, c_name, CASE WHEN c_acctbal < -500 THEN 0.0 ELSE c_acctbal END::DOUBLE AS c_acctbal,
         CASE WHEN c_acctbal < 0 THEN 'DORMANT' ELSE c_mktsegment END AS c_mktsegment
  FROM customer""")
def patch_cells(spark, folder):
    people = table(spark, folder, "customer").drop("c_nationkey")
    edits = people.where("c_acctbal < 0").select(
        F.col("c_custkey").alias("row"), F.lit("c_mktsegment").alias("col"), F.lit("DORMANT").alias("value")
    ).unionAll(
        people.where("c_acctbal < -500").select("c_custkey", F.lit("c_acctbal"), F.lit("0"))
    )
    return patch.patch_cells(
        people, "c_custkey", edits, ["c_mktsegment", "c_acctbal"], read_only=["c_name"]
    )


@query("""
  SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer
  UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier""")
def append_rows(spark, folder):
    people = table(spark, folder, "customer").drop("c_mktsegment")
    return patch.append_rows(people, table(spark, folder, "supplier"))


EDITED_SQL = """
  SELECT c_custkey, c_name, CASE WHEN c_acctbal >= -500 THEN c_acctbal END::DOUBLE AS c_acctbal,
         CASE WHEN c_nationkey = 3 THEN 'LAPSED' WHEN c_acctbal < 0 THEN 'DORMANT' ELSE c_mktsegment END AS c_mktsegment
  FROM customer"""
STORED_FILES = 16


def _edited(spark, folder, compact_between: bool) -> DataFrame:
    """The customers stored, edited twice, and read; the second edits win."""
    people = table(spark, folder, "customer")
    path = scratch_path(spark, "edit-store")
    edit_store.create(people.drop("c_nationkey"), "c_custkey", path, STORED_FILES)
    cell = [F.col("c_custkey").alias("row"), F.lit("c_mktsegment").alias("col")]
    dormant = people.where("c_acctbal < 0").select(*cell, F.lit("DORMANT").alias("value"))
    emptied = people.where("c_acctbal < -500").select("c_custkey", F.lit("c_acctbal"), F.lit(None).cast("string"))
    edit_store.edit(spark, path, dormant.unionAll(emptied))
    if compact_between:
        edit_store.compact(spark, path)
    edit_store.edit(spark, path, people.where("c_nationkey = 3").select(*cell, F.lit("LAPSED").alias("value")))
    return edit_store.read(spark, path)


@query(EDITED_SQL)
def stored_edits(spark, folder):
    return _edited(spark, folder, compact_between=False)


@query(EDITED_SQL)
def compacted_edits(spark, folder):
    return _edited(spark, folder, compact_between=True)


# ---- table view ----------------------------------------------------------------------------


@query("""
  SELECT count(*) AS total, count(*) FILTER (WHERE o_totalprice > 200000) AS filtered,
         CAST(ceil(count(*) FILTER (WHERE o_totalprice > 200000) / 25) AS BIGINT) AS pages
  FROM orders""")
def table_info(spark, folder):
    return view.info(table(spark, folder, "orders"), F.col("o_totalprice") > 200000, 25)


@query("""
  WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS row_id FROM orders),
  s AS (SELECT row_id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position
        FROM o WHERE o_totalprice > 200000)
  SELECT row_id, position, CAST(ceil(position / 25) AS BIGINT) AS page FROM s""")
def row_ids_passing(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    shown = [("o_totalprice", True), ("o_orderkey", False)]
    return view.row_ids(orders, F.col("o_totalprice") > 200000, [("o_orderkey", False)], shown, 25)


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate::VARCHAR"
       " AS shipped, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey,"
       " l_linenumber, l_shipdate) AS place FROM lineitem")
def numbered_rows(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"
    )
    order = ["l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
    placed = ranking.number_rows(rows, order, "place")
    shipped = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped")
    return placed.select(*order[1:5], "l_extendedprice", shipped, "place")


@query("""
  SELECT c_custkey, c_name, c_acctbal FROM customer
  ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50""")
def page_of_rows(spark, folder):
    people = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    return view.page(people, [("c_acctbal", True), ("c_custkey", False)], 3, 25)


@query("""
  SELECT o_orderkey, o_totalprice FROM orders
  ORDER BY o_totalprice, o_orderkey DESC LIMIT 100 OFFSET 900""")
def page_far_down(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    order = [("o_totalprice", False), ("o_orderkey", True)]
    return view.page(orders, order, 10, 100, shallow_rows=0)


@query("""
  WITH o AS (
    SELECT l_orderkey, l_linenumber, l_extendedprice, count(*) OVER () AS total,
           row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS i
    FROM lineitem)
  SELECT page, pages, l_orderkey, l_linenumber, l_extendedprice
  FROM (SELECT CAST((i - 1) // 50 + 1 AS INTEGER) AS page, CAST(ceil(total / 50) AS BIGINT) AS pages, * FROM o)
  WHERE page IN (1, 2, 71, pages // 2, pages)""")
def pages_of_stored_order(spark, folder):
    """The first, a middle and the last pages of lines by price, from one stored order."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    path = scratch_path(spark, "lines-by-price")
    order = [("l_extendedprice", True), ("l_orderkey", False), ("l_linenumber", False)]
    stored_order.store_order(lines, order, path)
    pages = stored_order.stored_info(spark, path, 50).first().pages
    shown = [
        stored_order.stored_page(spark, path, n, 50).select(F.lit(n).alias("page"), F.lit(pages).cast("bigint").alias("pages"), "*")
        for n in sorted({n for n in (1, 2, 71, pages // 2, pages) if 1 <= n <= pages})
    ]
    return reduce(DataFrame.unionAll, shown)


@query("""
  WITH o AS (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer),
  e AS (SELECT min(i) AS a, max(i) AS b FROM o WHERE c_custkey IN (100, 5))
  SELECT c_custkey, c_name, c_acctbal FROM o, e WHERE i BETWEEN a AND b""")
def row_block(spark, folder):
    people = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    return view.row_block(people, "c_custkey", 100, 5, [("c_acctbal", True), ("c_custkey", False)])


MISSING_PRICE_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price
  FROM orders"""


def _missing_price(spark, folder):
    price = F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice"))
    return table(spark, folder, "orders").select("o_orderkey", price.alias("price"))


@query(f"""
  SELECT * FROM ({MISSING_PRICE_SQL})
  ORDER BY price NULLS FIRST, o_orderkey DESC LIMIT 500 OFFSET 1000""")
def page_missing_order(spark, folder):
    """A page beyond row 1000 of an order with missing values."""
    order = [("price", False), ("o_orderkey", True)]
    return view.page(_missing_price(spark, folder), order, 3, 500)


@query(f"""
  WITH o AS (SELECT *, row_number() OVER (ORDER BY price DESC NULLS LAST, o_orderkey) AS i
             FROM ({MISSING_PRICE_SQL})),
  e AS (SELECT min(i) AS a, max(i) AS b FROM o WHERE o_orderkey IN (14, 5))
  SELECT o_orderkey, price FROM o, e WHERE i BETWEEN a AND b""")
def row_block_missing(spark, folder):
    """A block that ends at a row without a value in the order column."""
    order = [("price", True), ("o_orderkey", False)]
    return view.row_block(_missing_price(spark, folder), "o_orderkey", 14, 5, order)


@query(f"""
  SELECT c_custkey, c_name, format('{{:,.2f}}', c_acctbal) AS balance FROM customer
  WHERE c_custkey IN ({LINKED_SQL}) AND c_acctbal BETWEEN 100 AND 9000
    AND contains(lower(c_mktsegment), 'in')
    AND contains(concat_ws(' ', CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR),
                           regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', ''), c_mktsegment), '7')
  ORDER BY c_acctbal DESC, c_custkey LIMIT 10""")
def table_view(spark, folder):
    people = table(spark, folder, "customer")
    state = View(
        key="c_custkey",
        order=[("c_acctbal", True), ("c_custkey", False)],
        links=_links(spark, folder),
        filters=[
            predicates.in_range(F.col("c_acctbal"), 100, 9000),
            predicates.text_matches(F.col("c_mktsegment"), "IN"),
        ],
        search="7",
    )
    return state.page(people, 1).select(
        "c_custkey", "c_name", formats.format_round(F.col("c_acctbal"), 2).alias("balance")
    )


# ---- reshaping arrays, formats, checks -----------------------------------------------------


@query("""
  SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS place, CAST(embedding[i] AS DOUBLE) AS value,
         CAST(i * i AS INTEGER) AS square
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def arrays_to_rows(spark, folder):
    vectors = table(spark, folder, "embeddings").select(
        "vec_id", "label",
        F.transform("embedding", lambda x: x.cast("double")).alias("value"),
        F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda i: i * i).alias("square"),
    )
    return reshape.arrays_to_rows(vectors, ["vec_id", "label"], ["value", "square"])


@query("""
  SELECT vec_id, CAST(i - 1 AS INTEGER) AS place, CAST(embedding[i] AS DOUBLE) AS forward,
         CAST(embedding[len(embedding) + 1 - i] AS DOUBLE) AS backward
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def transpose_arrays(spark, folder):
    rows = F.transform(
        F.array("embedding", F.reverse("embedding")), lambda a: F.transform(a, lambda x: x.cast("double"))
    )
    turned = table(spark, folder, "embeddings").select(
        "vec_id", F.posexplode(reshape.transpose(rows)).alias("place", "pair")
    )
    return turned.select(
        "vec_id", "place", F.get("pair", F.lit(0)).alias("forward"), F.get("pair", F.lit(1)).alias("backward")
    )


@query("""
  SELECT l_orderkey, l_linenumber, '$' || format('{:,.2f}', l_extendedprice) AS price,
         CASE WHEN l_discount = 0 THEN 'none' ELSE format('{:.0f}%', l_discount * 100) END AS discount,
         format('{:.1f}', l_tax) AS tax,
         CASE WHEN l_quantity < 10 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
              ELSE CAST(CAST(floor(l_quantity / 10 + 0.5) AS INTEGER) AS VARCHAR) || 'e+1' END AS quantity,
         CASE WHEN l_extendedprice >= 100000 THEN format('{:,.2f}', l_extendedprice)
              WHEN l_extendedprice >= 10000 THEN format('{:,.3f}', l_extendedprice)
              WHEN l_extendedprice >= 1000 THEN format('{:,.4f}', l_extendedprice)
              WHEN l_extendedprice >= 100 THEN format('{:,.5f}', l_extendedprice)
              ELSE format('{:,.6f}', l_extendedprice) END AS price_8,
         coalesce('<' || nullif(l_returnflag, 'R') || '>', '') AS flag,
         strftime(l_shipdate, '%a %b %d %Y') AS shipped
  FROM lineitem""")
def format_columns(spark, folder):
    price = F.col("l_extendedprice")
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        formats.format_currency(price).alias("price"),
        formats.format_percent(F.col("l_discount"), zero="none").alias("discount"),
        formats.format_round(F.col("l_tax"), 1).alias("tax"),
        formats.format_signif(F.col("l_quantity"), 1).alias("quantity"),
        formats.format_signif(price, 8).alias("price_8"),
        formats.format_string(F.nullif("l_returnflag", F.lit("R")), "<", ">").alias("flag"),
        formats.format_date(F.col("l_shipdate")).alias("shipped"),
    )


@query("""
  SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '£'
           || format('{:,.2f}', abs(c_acctbal)) AS before,
         replace(replace(replace(format('{:,.2f}', c_acctbal), '.', 'd'), ',', '.'), 'd', ',')
           || '€' AS after,
         CASE WHEN c_acctbal < 0 THEN '' ELSE format('{:.2f}', c_acctbal) END AS plain
  FROM customer""")
def format_balances(spark, folder):
    balance = F.col("c_acctbal")
    texts = F.when(balance < 0, "..").otherwise(balance.cast("string"))
    return table(spark, folder, "customer").select(
        "c_custkey",
        formats.format_currency(balance, "£").alias("before"),
        formats.format_currency(balance, "€", mark=".", decimal=",", before=False).alias("after"),
        formats.format_round(texts, 2, mark="").alias("plain"),
    )


AUDITS = {
    "customer": ["c_custkey"],
    "orders": ["o_orderkey"],
    "part": ["p_brand", "p_type"],
    "lineitem": ["l_orderkey", "l_linenumber"],
}
AUDIT_SQL = "\n  UNION ALL ".join(
    f"""SELECT '{name}' AS table_name, (SELECT count(*) FROM {name}) AS n_rows,
         (SELECT count(*) FROM (SELECT DISTINCT * FROM {name})) AS n_distinct,
         (SELECT count(*) FROM (SELECT DISTINCT {', '.join(keys)} FROM {name})) AS n_keys"""
    for name, keys in AUDITS.items()
)


@query(f"SELECT *, n_rows = n_keys AS key_is_unique FROM ({AUDIT_SQL})")
def uniqueness_audit(spark, folder):
    audits = [quality.audit(table(spark, folder, n), n, keys) for n, keys in AUDITS.items()]
    first, *rest = audits
    for report in rest:
        first = first.unionAll(report)
    return first


@query("""
  SELECT 'nation' AS table_name, count(*) AS n_rows, 3 AS n_cols, count(*) = 25 AS as_expected FROM nation
  UNION ALL SELECT 'lineitem', count(*), 11, true FROM lineitem
  UNION ALL SELECT 'customer', count(*), 5, false FROM customer""")
def expected_shapes(spark, folder):
    return quality.contract({
        "nation": (table(spark, folder, "nation"), 25, 3),
        "lineitem": (table(spark, folder, "lineitem"), None, 11),
        "customer": (table(spark, folder, "customer"), None, 6),
    })
