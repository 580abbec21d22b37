import random
import re

import pytest
from pyspark.sql import functions as F

from wavebook.functions import text
from wavebook.operators import codebook


@pytest.mark.parametrize("dirty, clean", [
    ("CanÂ´t", "Can't"), ("donÂt", "don't"), ("thÃ¢t", "that"),
    ("CafÃ©", "Cafe"), ("donâ€™t", "don't"), ("â€˜x", "'x"), ("â€œx", '"x'), ("xâ€�", 'x"'), ("a\u0092b", "a'b"),
    ("Türkiye", "Turkiye"), ("Straße", "Strasse"), ("Œuvre ægis", "OEuvre aegis"), ("‘a’ “b” „c‟", "'a' \"b\" \"c\""),
    ("  \tLong blanks\n", "Long blanks"), ("Łódź, Ørsted, Đặng", "Lodz, Orsted, Dang"), ("été", "ete"),
    ("中文 Ελλ", "中文 Ελλ"), ("plain", "plain"), (None, None), ("ǽ", "ae"),
])
def test_clean_text(spark, dirty, clean):
    df = spark.createDataFrame([(dirty,)], "t string")
    assert df.select(text.clean_text(F.col("t"))).first()[0] == clean


def test_a_lone_mark_or_a_letter(spark):
    df = spark.createDataFrame([("Âge, donÂt",), ("xÂ y",)], "t string")
    assert [r[0] for r in df.select(text.clean_text(F.col("t"))).collect()] == ["'ge, don't", "x' y"]
    kept = df.select(text.clean_text(F.col("t"), keep_capital_a=True)).collect()
    assert [r[0] for r in kept] == ["Age, donAt", "x' y"]


def test_small_helpers(spark):
    row = spark.range(1).select(
        text.base_name(F.lit("WVS7/wvs7")), text.html_escape(F.lit('<a> & "b"')), text.paste(F.lit(1), F.lit(None))
    ).first()
    assert tuple(row) == ("wvs7", '&lt;a&gt; &amp; "b"', "1NA")


def test_codebook_labels(spark):
    df = spark.createDataFrame([(1,), (2,), (1,)], "A165 int")
    df = codebook.set_variable_labels(df, A165="Trust Ã© ")
    df = codebook.set_value_labels(df, A165={1: "Yes", 2: "No", 8: "Donâ€™t know"})
    book = codebook.from_metadata(df)
    assert [tuple(r) for r in book.orderBy("ord").collect()] == [
        ("A165", None, "Trust Ã© ", 0), ("A165", "1", "Yes", 1), ("A165", "2", "No", 2), ("A165", "8", "Donâ€™t know", 3),
    ]
    cleaned = codebook.clean(codebook.drop_unused(book, df, ["A165"]))
    assert [r.label for r in cleaned.orderBy("ord").collect()] == ["Trust e", "Yes", "No"]
    labelled = codebook.decode(df, codebook.clean(book), "A165", "label").orderBy("A165").collect()
    assert [r.label for r in labelled] == ["Yes", "Yes", "No"]
    placed = codebook.position(df, book, "A165", "place").orderBy("A165").collect()
    assert [r.place for r in placed] == [0, 0, 1]


def one_after_the_other(dirty: str) -> str:
    """The repair as its rules say it: every replacement over the whole text, in order."""
    for old, new in text.BROKEN_SEQUENCES + text.long_forms():
        dirty = dirty.replace(old, new)
    dirty = dirty.translate(str.maketrans(*text.ascii_table()))
    return re.sub(f"(?<=[A-Za-z])[{text.COMBINING}]+", "", dirty).strip(" \t\r\n")


def test_one_pass_is_as_good_as_one_replacement_after_the_other(spark):
    rng = random.Random(6)
    pieces = [old for old, _ in text.BROKEN_SEQUENCES + text.long_forms()] + list("ÂÃâ€\u0092´¢©™˜œ�”")
    pieces += list("abc \t\n'é漢́̈ŁøÇ“”‘’ …ﬁ–Ω😀") + [" plain words ", "𝔘"]
    dirty = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    df = spark.createDataFrame([(d,) for d in dirty], "t string").repartition(3)
    got = {r.t: r.c for r in df.select("t", text.clean_text(F.col("t")).alias("c")).collect()}
    assert {d: got[d] for d in dirty} == {d: one_after_the_other(d) for d in dirty}
