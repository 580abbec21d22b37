import random

import pytest
from pyspark.sql import functions as F

from tests.llm.plain import blank_words
from wavebook.llm import mixing


def plain_targets(sizes):
    """Shares by weight; what is above a limit is given to the others, again and again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values())
    free = set(names)
    while left > 1e-9 and free:
        unit = left / sum(weight[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += unit * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice((0, 3, 1000, rng.randint(1, 100_000))) for i in range(rng.randint(1, 9))}
    if seed % 2:
        sizes[None] = 777
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = plain_targets(sizes)
    assert got == {s: pytest.approx(t, rel=1e-9, abs=1e-6) for s, t in want.items()}


def test_every_stretch_holds_the_shares(spark):
    sizes = spark.createDataFrame([("a", 60_000), ("b", 30_000), ("c", 10_000)], "source string, source_size bigint")
    wanted = mixing.targets(sizes)
    slots = mixing.schedule(wanted, slots=4096).orderBy("slot").collect()
    share = {r.source: r.target for r in wanted.collect()}
    total = sum(share.values())
    seen = dict.fromkeys(share, 0)
    for i, r in enumerate(slots, 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - i * share[s] / total) < 6 for s in share)
    for source in share:
        ranks = [r["rank"] for r in slots if r.source == source]
        blocks = [r.block for r in slots if r.source == source]
        size = -(-{"a": 60_000, "b": 30_000, "c": 10_000}[source] // slots[0].block_words)
        assert ranks == list(range(len(ranks))) and blocks == [k % size for k in ranks]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "hot"])
def test_words_taken(spark, hot_folder, folder):
    folder = hot_folder if folder == "hot" else folder
    df = spark.read.parquet(f"{folder}/documents.parquet")
    rows = mixing.mix(df).collect()
    taken, target = {}, {}
    for r in rows:
        assert r.size == len(blank_words(r.text)) and 0 <= r.taken <= 2 * r.size and 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 10 for s in target)
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in mixing.mix(df.repartition(7)).collect())


def test_sources_of_a_few_blocks_come_near_their_targets(spark):
    """A long tail of small sources beside a large one, in blocks longer than most of them."""
    rng = random.Random(3)
    sizes = {"large": 40_000, None: 700} | {f"tail{i}": rng.choice((1, 4, 30, 300, 900, 1500)) for i in range(60)}
    rows = []
    for name, size in sizes.items():
        while size:
            n = min(size, rng.randint(1, 60))
            rows.append((len(rows), "w " * n, name))
            size -= n
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df, slots=128).collect()
    want = plain_targets(sizes)
    taken, copied = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        copied[r.source] += r.copies * r.size
    for s, target in want.items():
        assert abs(taken[s] - target) <= 0.01 * target + 10 and (taken[s] > 0) == (copied[s] > 0) == (target > 0)


def test_awkward_rows(spark, awkward, nothing):
    out = mixing.mix(awkward)
    rows = out.collect()
    assert len(rows) == awkward.count() and out.columns.count("size") == 1 and "kept" in out.columns
    assert all(r.taken == r.copies == 0 for r in rows if not (r.text or "").strip())
    assert mixing.mix(nothing).count() == 0
    blank = awkward.withColumn("text", F.lit(" "))
    assert {r.target for r in mixing.mix(blank).collect()} == {0.0}
