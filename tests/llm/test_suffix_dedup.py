import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.plain import removed_bytes
from wavebook.llm import suffix_dedup, texts
from wavebook.llm.suffix_order import suffix_order

NAMES = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
SENT = suffix_dedup._record(suffix_dedup.SURROUNDING, 0).schema


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(2000):
        text = [rng.randint(1, rng.choice((1, 2, 4, 50))) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])


def passages():
    """Texts with repeats inside, across, at the edges, just below the length, and periodic ones."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghij klmé") for _ in range(n))
    shared, exact, short = noise(700), noise(400).encode()[:400].decode("utf-8", "ignore"), noise(350)
    rows = [noise(300) + shared + noise(50), shared + noise(500), noise(20) + shared, shared[:500], noise(2000)]
    rows += [exact + noise(100), noise(90) + exact, short + noise(300), noise(300) + short, "ab" * 900, "of " * 200]
    rows += [noise(50) + "of " * 180 + noise(20), noise(450) * 2, None, "", "x" * 399, "x" * 400, "x" * 401]
    rows += [shared] * 5 + [noise(401)] * 2 + [noise(100) + shared + noise(100) + shared]
    rows += [noise(rng.randint(0, 900)) + shared[rng.randint(0, 300) :] + noise(rng.randint(0, 900)) for _ in range(40)]
    return rows


@pytest.mark.parametrize("spread", [False, True])
def test_same_as_brute_force(spark, monkeypatch, spread):
    """Also with every core spread out over buckets of strings."""
    if spread:
        monkeypatch.setattr(suffix_dedup, "SPREAD_COUNT", 1)
        monkeypatch.setattr(suffix_dedup, "SPREAD_SHARE", 0.0)
    rows = passages()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in suffix_dedup.suffix_dedup(df).collect()}
    assert [got[i] for i in range(len(rows))] == removed_bytes(rows)


def test_a_text_longer_than_a_piece_has_the_cores_of_its_windows(monkeypatch):
    data = np.random.default_rng(1).integers(97, 123, 20_000, dtype=np.uint8)
    whole = np.concatenate([p for _, p, _ in suffix_dedup.cores(data, np.array([0, len(data)]))])
    monkeypatch.setattr(suffix_dedup, "PIECE", 1500)
    pieces = np.unique(np.concatenate([p for _, p, _ in suffix_dedup.cores(data, np.array([0, len(data)]))]))
    assert pieces.tolist() == whole.tolist()


def removed_in_one_task(rows):
    """What the tasks of the operator give, one after the other in this process."""
    column = pa.array([t.encode() for t in rows], pa.binary())
    keys = pa.array([str(i).encode() for i in range(len(rows))], pa.binary())
    batch = pa.RecordBatch.from_arrays([column, keys], names=["text", "key"])
    counts = pa.Table.from_batches(suffix_dedup._count_cores(iter([batch]))).group_by("core").aggregate([("n", "sum")])
    again = counts.filter(pa.compute.greater(counts["n_sum"], 1))["core"].to_numpy().view(np.uint64)
    listed = np.zeros(suffix_dedup.FILTER_WORDS, dtype=np.uint64)
    np.bitwise_or.at(listed, (again % np.uint64(suffix_dedup.FILTER_WORDS)).astype(np.int64), suffix_dedup._bits(again))
    sent = pa.Table.from_batches(suffix_dedup._surroundings(iter([batch]), SimpleNamespace(value=(listed, {}))), SENT)
    order = np.lexsort([sent[c].to_numpy() for c in ("bucket", "core", "kind")])
    spans = {}
    for met in suffix_dedup._meet(iter(sent.take(pa.array(order)).combine_chunks().to_batches())):
        for key, pairs in zip(met.column(0).to_pylist(), met.column(1).to_pylist()):
            spans.setdefault(int(key), []).append(pairs)
    listed = pa.array([spans.get(i) for i in range(len(rows))], pa.list_(pa.list_(pa.int32())))
    found = suffix_dedup._remove(pa.RecordBatch.from_arrays([column, listed], names=["text", "spans"]), "text", "spans")
    return list(zip(*(found[n].to_pylist() for n in NAMES)))


def test_texts_longer_than_a_piece(monkeypatch):
    """Clean ones lose nothing; repeats within, across and at the cuts all go."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 1500)
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefghij klm") for _ in range(n))
    clean = [noise(n) for n in (1500, 1899, 1900, 3000, 9000, 20_000)]
    assert removed_in_one_task(clean) == removed_bytes(clean)
    assert all(r[1] == 0 for r in removed_in_one_task(clean))
    shared = noise(900)
    rows = [*clean, noise(1200) + shared + noise(4000), noise(5000) + shared, noise(700) + shared * 2 + noise(1600), "of " * 2000]
    assert removed_in_one_task(rows) == removed_bytes(rows)


def test_whole_tables(spark, hot_folder):
    for folder in ("/root/testdata/sf0.001", hot_folder):
        df = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
        rows = df.collect()
        got = {r.doc_id: tuple(r[n] for n in NAMES) for r in suffix_dedup.suffix_dedup(df).collect()}
        assert [got[r.doc_id] for r in rows] == removed_bytes([r.text for r in rows])


def test_awkward_rows(spark, awkward, nothing):
    out = suffix_dedup.suffix_dedup(awkward.withColumn("n_bytes", F.lit("clash")))
    assert out.count() == awkward.count() and out.columns == [*awkward.columns, *NAMES]
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[4].n_bytes == 0 and by_id[15].n_removed == 5000 and by_id[1].n_removed == 0
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


def test_hashes_of_equal_words_are_equal():
    import pyarrow as pa

    column = pa.array(["The cat, the CAT", None, "", "é" * 3000 + " the"])
    hashes, starts, ends, rows = texts.words(column)
    assert rows.tolist() == [0, 4, 4, 4, 6] and hashes[0] == hashes[2] == hashes[5] and hashes[1] == hashes[3]
    assert (ends - starts).tolist() == [3, 3, 3, 3, 6000, 3]


def test_words_are_not_cut_at_pieces(monkeypatch):
    import pyarrow as pa

    column = pa.array(["a" * 300 + " bb ccc " * 40 + "d" * 95, "e" * 10, " f " * 50])
    whole = texts.words(column)
    for piece in (7, 64, 100, 333):
        monkeypatch.setattr(texts, "PIECE", piece)
        assert all((a == b).all() for a, b in zip(whole, texts.words(column)))
