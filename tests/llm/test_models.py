"""Language and quality: held-out accuracy, the parts, awkward rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavebook.llm import language, quality, queries

FOLDER = "/root/testdata/sf0.01"


def held_out(key, folds):
    return zlib.crc32(str(key).encode()) % folds == 0


def test_language_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = queries.op7_language_mixture(spark, FOLDER).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == held_out(r.doc_id, 5) and 0 <= r.score <= 1 for r in got)
    unseen = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in unseen]) > 0.98


def test_languages_of_a_mixed_text(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    langs, model = language.train(docs)
    pick = lambda lang: docs.where((F.col("lang") == lang) & (F.col("n_chars") > 3000)).first().text[:3000]
    column = pa.array([pick("en") + " " + pick("de"), pick("fr")])
    shares = language.infer(*language.cells(column), 2, model)
    mixed = {langs[k]: s for k, s in enumerate(shares[0]) if s > 0}
    assert set(mixed) == {"en", "de"} and 0.35 < mixed["en"] < 0.65
    assert (shares[1] > 0).sum() == 1 and langs[int(shares[1].argmax())] == "fr"


def test_trigrams_do_not_depend_on_the_batch():
    texts = ["abc abd", "", None, "ABC  abd!!", "é" * 10]
    together = [sorted(zip(c[r == i].tolist(), n[r == i].tolist())) for r, c, n in [language.cells(pa.array(texts))] for i in range(5)]
    alone = [sorted(zip(c.tolist(), n.tolist())) for t in texts for r, c, n in [language.cells(pa.array([t], pa.string()))]]
    assert together == alone and together[1] == together[2] == []


def test_very_long_texts_count_whole():
    long = "abcdefg " * 1_500_000
    _, cell, count = language.cells(pa.array([long]))
    _, small, part = language.cells(pa.array(["abcdefg " * 1000]))
    assert set(cell.tolist()) == set(small.tolist()) and count.sum() == len(long) - 2


def test_languages_of_awkward_rows(spark, awkward, nothing):
    model = language.train(awkward)
    out = language.identify(awkward.withColumn("score", F.lit("clash")), model)
    of = {r.doc_id: r for r in out.collect()}
    assert out.count() == awkward.count() and out.columns.count("score") == 1
    assert {of[i].lang_pred for i in (4, 5, 6, 9)} == {"und"} and of[14].lang_pred == "ja" and of[7].lang_pred == "fr"
    assert of[9].score == 0.0 and of[9].langs == []
    assert language.identify(nothing, model).count() == 0
    bare = language.train(nothing)
    assert {r.lang_pred for r in language.identify(awkward, bare).collect()} == {"und"}


def test_quality_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    got = queries.op6_quality_lsa_neighbours(spark, FOLDER).collect()
    assert len(got) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.held_out == held_out(r.doc_id, 5) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    unseen = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([p == q for p, q in unseen if q == 1]) > 0.97
    assert np.mean([p == q for p, q in unseen if q == 0]) > 0.8


def test_cosines_are_exact(spark):
    """Against a plain search over all labelled vectors."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(300).collect()
    counts = quality.terms(pa.array([r.text for r in docs]))
    labels = np.array([r.doc_id % 3 == 0 for r in docs], dtype=float)
    model = quality.Model(np.ones(quality.CELLS), counts[:200], labels[:200])
    got = model.score(counts[200:])
    rows = quality.weighted(counts[200:], model.idf).astype(np.float32) @ model.directions
    for row, score in zip(rows, got):
        cosines = model.vectors @ (row / np.linalg.norm(row))
        nearest = np.argsort(-cosines)[: quality.NEIGHBOURS]
        weight = np.maximum(cosines[nearest].astype(float), 0) ** quality.SHARPNESS
        assert score == pytest.approx((weight * labels[:200][nearest]).sum() / weight.sum(), abs=1e-3)


def test_quality_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (3, 1), (9, 0), (15, 0), (15, 1), (99, 1), (2, None)], "doc_id bigint, quality int")
    model = quality.train(awkward, labels)
    assert len(model.labels) == 5
    out = quality.classify(awkward.withColumn("score", F.lit("clash")), model)
    rows = out.collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if not (r.text or "").strip()} == {model.prior}
    assert quality.classify(nothing, model).count() == 0
    bare = quality.train(nothing, labels)
    assert {r.score for r in quality.classify(awkward, bare).collect()} == {0.5}
