import duckdb
import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, size string, row int"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards box with grey quails near old mills"


def long_text(words: int = 60_000) -> str:
    return " ".join(f"word{i * 7919 % 4001}" for i in range(words))


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    copy = PROSE + " and so it goes on and on until the very end of this rather long and winding sentence"
    near = copy.replace("winding", "twisting")
    rows = [
        (1, copy, "en", "a", 1), (2, copy, "en", "a", 1), (3, near, "en", "b", 2), (4, None, "en", "a", 0),
        (5, "", "en", "b", 0), (6, " \t\n", None, None, 3), (7, "Été à la plage, où êtes-vous ?", "fr", "c", 9),
        (8, long_text(), "en", "a", 9), (9, "1234 5678 !!!", "en", "c", 4), (10, "one two", None, None, None),
        (10, "one two", None, None, None), (None, "a row without an id", "en", None, 5), (None, None, None, None, None),
        (11, " the quick brown fox ", "en", "b", 2), (12, "the quick brown fox", "en", "b", 2),
        (13, "der schnelle braune Fuchs springt über den faulen Hund", "de", "c", 8), (14, "漢字 かな 漢字", "ja", "d", 5),
        (15, "x" * 5000, "en", "d", 5000), (16, "\x00 nul \x0b tab", "en", "d", 9),
    ]
    return [(*r, "clash", "clash", 7) for r in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def hot_folder(tmp_path_factory):
    """Documents of which a third are one text and a third have one source, with a passage in many."""
    folder = tmp_path_factory.mktemp("hot-documents")
    con = duckdb.connect()
    con.execute(f"""
      COPY (SELECT * REPLACE (
              CASE WHEN doc_id % 3 = 0 THEN 'One text that a third of all documents share, word for word, again and again.'
                   WHEN doc_id % 3 = 1 THEN text || ' {PROSE * 6}' ELSE text END AS text,
              CASE WHEN doc_id % 3 = 1 THEN 'src0' WHEN doc_id % 50 = 0 THEN NULL ELSE source END AS source)
            FROM '/root/testdata/sf0.001/documents.parquet') TO '{folder}/documents.parquet' (FORMAT parquet)""")
    for name in ("benchmark", "labels", "pages"):
        con.execute(f"COPY (FROM '/root/testdata/sf0.001/{name}.parquet') TO '{folder}/{name}.parquet' (FORMAT parquet)")
    con.execute(f"""
      COPY (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN first_value(embedding) OVER (ORDER BY vec_id) ELSE embedding END AS embedding,
                   CASE WHEN vec_id % 3 = 1 THEN 1 ELSE label END AS label
            FROM '/root/testdata/sf0.01/embeddings.parquet') TO '{folder}/embeddings.parquet' (FORMAT parquet)""")
    return str(folder)
