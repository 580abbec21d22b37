import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.plain import components, letter_words, shingles
from wavebook.llm import near_dedup


def families(spark):
    """Base texts, copies of them with some words changed, a large family, and short texts."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    bases = [[word() for _ in range(rng.randint(20, 200))] for _ in range(60)]
    texts = [" ".join(b) for b in bases]
    for b in bases[:40]:
        for _ in range(3):
            changed = [word() if rng.random() < rng.choice((0.005, 0.015, 0.05, 0.2)) else w for w in b]
            texts.append(" ".join(changed).upper() + " !")
    for _ in range(300):
        texts.append(" ".join(word() if rng.random() < 0.008 else w for w in bases[50]))
    texts += [texts[0]] * 200 + ["one two three", "One, two: three", "one two", "...", "...", "", None]
    return texts


def test_classes_of_similar_texts(spark):
    texts = families(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r for r in near_dedup.near_dedup(df).collect()}
    sets = [shingles(t) for t in texts]
    near, far = [], []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b:
                union = sum((a | b).values())
                same = sum((a & b).values()) / union
                (near if same >= 0.83 else far if same < 0.76 else []).append((j, i))
            elif (texts[i] or "") == (texts[j] or ""):
                near.append((j, i))
    # Every clear pair is in one class, and classes hold nothing that no chain of pairs explains.
    assert [p for p in near if got[p[0]].class_id != got[p[1]].class_id] == []
    apart = set(far)
    chained = components(range(len(texts)), [(j, i) for i in range(len(texts)) for j in range(i) if (j, i) not in apart and (sets[i] and sets[j])] + near)
    for key, row in got.items():
        assert chained[key] == chained[row.class_id]
        assert row.kept == (key == row.class_id)
    sizes = {}
    for row in got.values():
        sizes[row.class_id] = sizes.get(row.class_id, 0) + 1
    assert all(row.class_size == sizes[row.class_id] for row in got.values())


def test_edges_of_a_family_are_linked_by_members_that_leave_with_the_leader(spark):
    """Edges are similar to members, but not to the text that leads the only bucket they share."""
    hub = [f"w{i}" for i in range(200)]
    texts = {0: hub, 1: [f"other{i}" for i in range(30)]}
    for i in range(30):
        texts[10 + i] = hub[:20] + [f"a{i}x{k}" for k in range(12)] + hub[32:]
        texts[100 + i] = texts[10 + i][:120] + [f"b{i}x{k}" for k in range(12)] + texts[10 + i][132:]
    rows = [(k, " ".join(words)) for k, words in texts.items()]
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in rows], "key bigint, text string, bytes bigint")
    same = bytearray(near_dedup.SAMPLES)
    signed = spark.createDataFrame(
        [(k, {0: [1, 2], 1: [2]}.get(k, [1]), same) for k in texts], "key bigint, bands array<bigint>, samples binary"
    )
    levels = spark.sparkContext.broadcast(np.zeros(near_dedup.CELLS, dtype=np.int8))
    _, named = near_dedup.find_links(docs, signed, levels, 0.8)
    assert {r.key: r["class"] for r in named.collect()} == {k: 0 for k in texts if k != 1}


def loose_family(n, seed=2):
    """Texts that each differ from one base in some places, so that most pairs are just below the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    base = [word() for _ in range(120)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.choice((1, 1, 2, 2, 3, 4))):
            own[rng.randrange(120)] = word()
        out.append(" ".join(own))
    return out


def test_recall_of_weighted_pairs_in_a_loose_family(spark):
    """Of all pairs that weighted brute force finds at 0.8 and more, nine tenths at least share a class."""
    texts = loose_family(2500) + [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(df).collect()}
    levels = near_dedup.idf_levels(df, "text")
    sets = [shingles(t) for t in texts[:2500]]
    place = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    hashed, level, _, rows = near_dedup.weighted_sets(pa.array(texts[:2500]), levels)
    assert len(np.unique(hashed)) == len(place)
    column = np.unique(hashed, return_inverse=True)[1]
    weights = near_dedup.LEVEL_WEIGHTS[level]
    found, wanted = 0, 0
    whole = np.zeros((2500, len(place)), dtype=np.float32)
    whole[np.repeat(np.arange(2500), np.diff(rows)), column] = np.sqrt(weights)
    shared = whole @ whole.T
    total = np.diag(shared)
    similar = shared / (total[:, None] + total[None, :] - shared)
    a, b = np.nonzero(np.triu(similar >= 0.8, 1))
    wanted = len(a)
    found = sum(got[int(i)] == got[int(j)] for i, j in zip(a, b))
    below = (np.triu(similar < 0.8, 1) & np.triu(np.ones_like(similar, dtype=bool), 1)).sum()
    assert below > wanted > 10_000 and found >= 0.9 * wanted
    assert all(got[i] == i for i in range(2500, 3000))


def test_candidates_are_no_more_than_members(spark, monkeypatch):
    """Pairs grow with the members of a family, not with their square."""
    made = {}
    candidates = near_dedup._candidates

    def counted(shared, leaders, signed):
        pairs = candidates(shared, leaders, signed)
        made[n] = made.get(n, 0) + pairs.count()
        return pairs

    monkeypatch.setattr(near_dedup, "_candidates", counted)
    for n in (300, 900):
        df = spark.createDataFrame(list(enumerate(loose_family(n))), "doc_id bigint, text string")
        near_dedup.near_dedup(df).count()
    assert made[900] < 4.5 * made[300]


def test_document_frequencies_of_cells(spark):
    texts = families(spark)
    levels = near_dedup.idf_levels(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), "text")
    seen = np.zeros(near_dedup.CELLS)
    for t in texts:
        hashed, _, _, _ = near_dedup.weighted_sets(pa.array([t], pa.string()), levels)
        seen[np.unique(near_dedup._cell(hashed))] += 1
    idf = np.log((1 + len(texts)) / (1 + seen)) / np.log(1 + len(texts))
    assert (levels == np.rint(idf * (near_dedup.LEVELS - 1))).all()


def test_chunks_of_members_meet_parts_of_leaders(spark, monkeypatch):
    texts = families(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {r.doc_id: r.class_id for r in near_dedup.near_dedup(df).collect()}
    monkeypatch.setattr(near_dedup, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(near_dedup, "CHUNK_MEMBERS", 7)
    assert {r.doc_id: r.class_id for r in near_dedup.near_dedup(df).collect()} == want


def test_similarity_is_the_share_of_weights():
    a = (np.array([1, 2, 5], dtype=np.uint64), np.array([1.0, 2.0, 1.0]))
    b = (np.array([2, 5, 9], dtype=np.uint64), np.array([1.0, 1.0, 4.0]))
    assert near_dedup.similarity(a, b) == pytest.approx(2 / 8)
    assert near_dedup.similarity(a, a) == 1.0


def test_samples_agree_as_often_as_texts_are_similar():
    """A chance per sample equal to the weighted similarity: bands agree with its fifth power."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    levels = np.zeros(near_dedup.CELLS, dtype=np.int8)
    agree, expected = 0.0, 0.0
    for _ in range(150):
        base = [word() for _ in range(120)]
        other = [word() if rng.random() < 0.02 else w for w in base]
        a, b = " ".join(base), " ".join(other)
        keys, _ = near_dedup.bands(*near_dedup.weighted_sets(pa.array([a, b]), levels))
        agree += (keys[0] == keys[1]).mean()
        x, y = shingles(a), shingles(b)
        expected += (sum((x & y).values()) / sum((x | y).values())) ** near_dedup.ROWS_PER_BAND
    assert agree / 150 == pytest.approx(expected / 150, abs=0.05)


def test_repeated_words_weigh_more():
    levels = np.zeros(near_dedup.CELLS, dtype=np.int8)
    text = "a b c d e " * 30
    _, _, counts, rows = near_dedup.weighted_sets(pa.array([text, "a b c d e"]), levels)
    assert sorted(counts[: rows[1]].tolist()) == [29, 29, 29, 29, 30] and counts[rows[1] :].tolist() == [1]
    assert len(letter_words(text)) == 150


def test_awkward_rows(spark, awkward, nothing):
    out = near_dedup.near_dedup(awkward)
    rows = out.collect()
    assert out.columns == [c for c in awkward.columns if c != "kept"] + ["class_id", "class_size", "kept"]
    assert len(rows) == awkward.count()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
    assert {of[i][0].class_id for i in (1, 2, 3)} == {1} and {of[i][0].class_id for i in (11, 12)} == {11}
    assert sorted(r.kept for r in of[10]) == [False, True] and of[10][0].class_size == 2
    assert {of[i][0].class_id for i in (4, 5)} == {4} and of[6][0].class_id == 6
    empty = [r for r in rows if r.text is None and r.doc_id is None]
    assert empty[0].class_id == 4 and empty[0].kept is False
    alone = [r for r in rows if r.text == "a row without an id"]
    assert alone[0].class_id is None and alone[0].kept
    assert near_dedup.near_dedup(nothing).count() == 0


def test_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other")], "doc_id bigint, text string")
    names = ["key", "id", "rid", "bands", "SAMPLES", "class", "Rows", "best", "_kept_0", "_of_text", "bucket", "n"]
    for name in names:
        df = df.withColumn(name, F.lit(f"MINE {name}"))
    rows = near_dedup.near_dedup(df.withColumn("KEPT", F.lit("gone"))).collect()
    assert {r.doc_id: r.class_id for r in rows} == {1: 1, 2: 1, 3: 3}
    assert all(r[name] == f"MINE {name}" for r in rows for name in names) and "KEPT" not in rows[0].asDict()


def test_small_tables_of_the_rounds_are_few_files(spark):
    """A shuffle of many partitions doesn't make a file of each where the number of rows is known."""
    many = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        links = spark.createDataFrame([(i, i + 1, 0.9) for i in range(200) if i % 50], "a bigint, b bigint, similarity double")
        named = near_dedup.classes(links)
        assert {r.key: r["class"] for r in named.collect()} == {i: (i - 1) // 50 * 50 + 1 for i in range(1, 201)}
        assert len(named.inputFiles()) == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
