"""Queries with SQL against it, on given, awkward and hot documents."""

import duckdb
import pytest

from tests.compare import differences
from tests.llm.conftest import awkward_rows
from wavebook.llm import queries

SQL = queries.registry.sql
FOLDERS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]
TABLES = ("documents", "benchmark", "embeddings", "labels", "pages")


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet(['{folder}/{name}.parquet'])")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("folder", FOLDERS)
def test_same_as_sql(spark, folder, name):
    assert differences(queries.registry.queries[name](spark, folder), connect(folder), SQL[name]) == []


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql_on_hot_documents(spark, hot_folder, name):
    assert differences(queries.registry.queries[name](spark, hot_folder), connect(hot_folder), SQL[name]) == []


@pytest.fixture(scope="module")
def awkward_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("awkward"))
    rows = [r for r in awkward_rows() if "\x00" not in (r[1] or "")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, size string, row int")
    documents.drop("row").coalesce(1).write.parquet(f"{folder}/spark-documents")
    items = [(1, rows[0][1]), (2, "One TWO"), (3, None), (4, ""), (None, "no id"), (5, "one two"), (1, rows[0][1])]
    spark.createDataFrame(items, "item_id bigint, text string").coalesce(1).write.parquet(f"{folder}/spark-benchmark")
    urls = [
        "http://example.org/es/1", "HTTP://WWW.EXAMPLE.ORG/ES/1", "https://a.b.example.org/en/1234?q#f", "http://org", "http://org/",
        "http://notexample.org/es/", "x", None, "", "http://", "http:///path", "http://com/fr/", "http://x.com/de/?a", "http://x.com/fr",
        "http://example.org.", "a://b://example.org/es/", "http://user@example.org:80/es/", "http://.org/", "http://x.org?y/es/",
        "http://é.example.org/en/1", "http://example.org/" + "p" * 3000,
    ]
    pages = [(i, u) for i, u in enumerate(urls * 2)] + [(0, urls[0]), (None, urls[0]), (None, None)]
    spark.createDataFrame(pages, "page_id bigint, url string").coalesce(1).write.parquet(f"{folder}/spark-pages")
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages"):
        con.execute(f"COPY (FROM '{folder}/spark-{name}/*.parquet') TO '{folder}/{name}.parquet' (FORMAT parquet)")
    # Gaps in every column, values that are not finite, ids and rows twice, equal vectors, zeros.
    con.execute(f"""
      COPY (SELECT CASE WHEN vec_id % 11 = 3 THEN NULL WHEN vec_id % 11 = 4 THEN vec_id - 4 ELSE vec_id END AS vec_id,
                   CASE WHEN vec_id % 13 = 5 THEN NULL
                        WHEN vec_id % 13 = 6 THEN list_transform(embedding, lambda x, i: CASE WHEN i = 9 THEN NULL ELSE x END)
                        WHEN vec_id % 13 = 7 THEN list_transform(embedding, lambda x, i: CASE WHEN i = 9 THEN 'nan'::FLOAT ELSE x END)
                        WHEN vec_id % 13 = 8 THEN list_transform(embedding, lambda x, i: CASE WHEN i = 9 THEN '-inf'::FLOAT ELSE x END)
                        WHEN vec_id % 13 = 9 THEN list_transform(embedding, lambda x: 0::FLOAT)
                        ELSE embedding END AS embedding,
                   CASE WHEN vec_id % 17 = 9 THEN NULL ELSE label END AS label
            FROM '/root/testdata/sf0.01/embeddings.parquet'
            UNION ALL FROM '/root/testdata/sf0.001/embeddings.parquet') TO '{folder}/embeddings.parquet' (FORMAT parquet)""")
    con.execute(f"COPY (SELECT 1::BIGINT AS doc_id, 1 AS quality, 0 AS toxic) TO '{folder}/labels.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql_on_awkward_rows(spark, awkward_folder, name):
    assert differences(queries.registry.queries[name](spark, awkward_folder), connect(awkward_folder), SQL[name]) == []


def test_every_operator_has_a_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.registry.queries)
    assert numbers == list(range(1, 14))
