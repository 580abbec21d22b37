import numpy as np
import pytest
from pyspark.sql import functions as F

from wavebook.llm import hard_negatives as hn


def vectors(n, size=70, seed=3):
    draw = np.random.default_rng(seed)
    return np.floor(256 * draw.standard_normal((n, size)) / np.sqrt(size)).astype(np.int64)


def plain(rows, every):
    """All pairs, sorted; rows are (id, vector, label)."""
    rows = [r for r in rows if r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    size = max((len(v) for _, v, _ in rows), default=0)
    whole = [[int(np.floor(256 * float(x))) for x in v] + [0] * (size - len(v)) for _, v, _ in rows]
    score = lambda i, j: sum(a * b for a, b in zip(whole[i], whole[j]))
    order = lambda found: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    out = []
    for i, (anchor, _, label) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        others = [(score(i, j), rows[j][0], rows[j][2]) for j in range(len(rows)) if j != i]
        for p, positive, _ in order([x for x in others if x[2] == label])[:5]:
            fit = [x for x in others if x[2] != label and 50 * p <= 100 * x[0] <= 95 * p]
            out += [(anchor, positive, k + 1, x[1], p, x[0]) for k, x in enumerate(order(fit)[:3])]
    return sorted(out, key=str)


def found(spark, rows, every):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    return sorted((tuple(r) for r in hn.hard_negatives(df, every).collect()), key=str)


def test_intervals_hold_the_score_at_every_level():
    rows, turns = vectors(400), hn.rotations(2)
    coded = hn.encode(rows, turns)
    for i in range(20):
        anchor = hn.Anchor(rows[i], turns)
        scores = (rows @ rows[i]).astype(float)
        seen = []

        def possible(low, high):
            assert (low <= scores).all() and (scores <= high).all()
            seen.append((high - low).mean())
            return np.ones(len(low), dtype=bool)

        hn.survivors(anchor, np.arange(len(rows)), coded, possible)
        assert len(seen) == hn.LEVELS and seen[-1] < seen[0] / 3


def test_most_rows_are_dropped_by_their_codes():
    rows, turns = vectors(4000, 64), hn.rotations(1)
    coded = hn.encode(rows, turns)
    anchor = hn.Anchor(rows[0], turns)
    floor = np.sort(rows[1:] @ rows[0])[-5]
    left = hn.survivors(anchor, np.arange(1, 4000), coded, lambda low, high: high >= floor)
    assert len(left) < 400


def test_alignment_is_the_cosine_with_the_code():
    rows, turns = vectors(50, 64), hn.rotations(1)
    bits, norms, alignments = hn.encode(rows, turns)
    code = np.unpackbits(bits[:, 0].copy().view(np.uint8).reshape(50, -1), axis=1, bitorder="little") * 2.0 - 1.0
    cosine = ((rows @ turns[0]) * code).sum(axis=1) / (np.linalg.norm(rows, axis=1) * 8)
    assert alignments[:, 0] == pytest.approx(cosine)
    assert norms[:, 1] == pytest.approx(norms[:, 0] * np.sqrt(1 - cosine**2))


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_all_pairs_with_ties_and_a_hot_label(spark, monkeypatch, seed):
    monkeypatch.setattr(hn, "CHUNK_ROWS", 37)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 5)
    draw = np.random.default_rng(seed)
    points = draw.standard_normal((300, 20)) / 4
    points[100:180] = points[100]
    rows = [(i, [float(np.float32(x)) for x in p], 1 if i % 2 else int(draw.integers(0, 4))) for i, p in enumerate(points)]
    rows += rows[:20] + [(None, rows[0][1], 1), (None, rows[0][1], 2), (10, rows[3][1], 2)]
    assert found(spark, rows, 10) == plain(rows, 10)


def test_gaps_short_vectors_and_large_numbers(spark):
    rows = [
        (0, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.5, 2.0], 2), (3, [], 1), (4, None, 1), (5, [1.0, None], 1),
        (6, [float("nan")], 1), (7, [float("inf")], 2), (8, [1.0, 2.0, 2.5], None), (None, [1.0, 2.0, 2.5], 1),
        (10, [0.0, 0.0, 0.0], 2), (20, [-1.0, -2.0, -3.0], 1), (30, [0.5, 1.0, 1.5], 2), (30, [0.5, 1.0, 1.5], 2),
    ]
    assert found(spark, rows, 10) == plain(rows, 10)
    # Beyond the whole numbers of doubles.
    large = [(i, [float(2**22 + i * 512), float(i)], i % 2) for i in range(12)]
    assert found(spark, large, 4) == plain(large, 4)


def test_empty_table_no_anchors_and_clashing_names(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert hn.hard_negatives(spark.createDataFrame([], schema), 50).count() == 0
    assert found(spark, [(1, [1.0], 0), (2, [1.0], 1)], 50) == []
    rows = [(0, [1.0], 0), (1, [1.0], 0), (2, [0.9], 1)]
    df = spark.createDataFrame(rows, schema)
    for name in ("row", "ROW", "vector", "bits", "block", "targets", "score", "rank", "ANCHOR"):
        clash = df.withColumn(name, F.lit("MINE"))
        assert [tuple(r) for r in hn.hard_negatives(clash, 50).collect()] == [(0, 1, 1, 2, 65536, 58880)]
