import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.plain import blank_words
from wavebook.llm import queries, suffix_tree_lm as lm


class PlainTree:
    """The whole model on dictionaries: every run counted, every context tested."""

    def __init__(self, texts, depth=lm.DEPTH):
        sequences = [[*blank_words(t), None] for t in texts]
        self.words = Counter(w for s in sequences for w in s)
        self.mass = sum(self.words.values()) + len(self.words) + 1
        self.kept = {}
        for size in range(1, depth + 1):
            nexts = defaultdict(Counter)
            for s in sequences:
                for i in range(size, len(s)):
                    nexts[tuple(s[i - size : i])][s[i]] += 1
            tested = {}
            for context, seen in nexts.items():
                total = sum(seen.values())
                own = {w: (n - lm.DISCOUNT) / total for w, n in seen.items() if n >= 2}
                left = 1 - sum(own.values())
                gain = sum(
                    seen[w] * math.log((o + left * self.p(context[1:], w)) / self.p(context[1:], w)) for w, o in own.items()
                )
                gain += sum(n for w, n in seen.items() if w not in own) * math.log(max(left, 1e-12))
                if own and gain > lm.DIVERGENCE * len(own):
                    tested[context] = (left, own)
            self.kept |= tested

    def p(self, history, word):
        p = (self.words[word] + 1) / self.mass
        for size in range(1, min(len(history), lm.DEPTH) + 1):
            found = self.kept.get(tuple(history[-size:]))
            if found:
                p = found[0] * p + found[1].get(word, 0.0)
        return p

    def score(self, text):
        s = [*blank_words(text), None]
        return sum(math.log10(self.p(s[max(0, i - lm.DEPTH) : i], w)) for i, w in enumerate(s))


def same_as_plain(spark, docs):
    """Rows (key, text, train) scored by the operator and by the plain model."""
    tree = PlainTree([t for _, t, train in docs if train])
    df = spark.createDataFrame(docs, "key bigint, text string, train boolean").repartition(5)
    got = {r.key: r for r in lm.score(df, "train", carry=["key"]).collect()}
    assert sorted(got) == sorted(k for k, _, _ in docs)
    for key, text, _ in docs:
        assert got[key].score == pytest.approx(tree.score(text), rel=1e-9, abs=1e-9), text[:80]
        assert got[key].n_known == sum(tree.words[w] > 0 for w in [*blank_words(text), None])
    return tree


def whole_tables(folder, spark):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in rows]


def test_base_scores_of_whole_tables(spark, hot_folder):
    for folder in ("/root/testdata/sf0.001", hot_folder):
        rows = whole_tables(folder, spark)
        tokens = {d: [*blank_words(t), None] for d, t, _ in rows}
        counts = Counter(t for d, _, train in rows if train for t in tokens[d])
        n, v = sum(counts.values()), len(counts)
        got = queries.op2_suffix_tree_lm(spark, folder).collect()
        assert len(got) == len(rows)
        learned = {d: train for d, _, train in rows}
        for r in got:
            own = tokens[r.doc_id]
            assert (r.held_out, r.n_tokens, r.train_tokens) == (not learned[r.doc_id], len(own), n)
            assert r.n_known == sum(counts[t] > 0 for t in own)
            assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), rel=1e-9)
            assert r.score <= 0
        # The tree knows more than single words, also of texts it has not seen.
        unseen = [r for r in got if r.held_out]
        assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


@pytest.mark.parametrize("task, ranked", [(1 << 20, 1 << 20), (2000, 1 << 20), (300, 1 << 20), (2000, 200)])
def test_scores_are_those_of_the_plain_tree(spark, hot_folder, monkeypatch, task, ranked):
    """Whole texts, with one bucket or many, spread words and pairs, and words without a rank."""
    monkeypatch.setattr(lm, "TASK", task)
    monkeypatch.setattr(lm, "FREQUENT", ranked)
    spreads = []
    plain = lm._spread
    monkeypatch.setattr(lm, "_spread", lambda *args: spreads.append(plain(*args)) or spreads[-1])
    tree = same_as_plain(spark, whole_tables(hot_folder, spark))
    assert sum(len(c) == 3 for c in tree.kept) > 20
    spread, contexts = spreads[0]
    assert (spread.buckets > 10) == (task < 1 << 20) and bool(contexts) == (task < 1 << 20)
    if task == 300:
        assert any(b for _, b in contexts.values()), "no pair is spread"


def test_contexts_seen_twice_count_at_any_size(spark):
    """A passage that two of many texts share is told better than one that stands once."""
    rng = np.random.default_rng(4)
    noise = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 60)) for _ in range(1500)]
    twice, once = ([f"{kind}{i} {kind}{i + 1}" for i in range(30)] for kind in ("t", "o"))
    twice, once = " ".join(twice), " ".join(once)
    docs = [(i, t, True) for i, t in enumerate([*noise, twice, twice, once])]
    same_as_plain(spark, docs)
    df = spark.createDataFrame(docs, "key bigint, text string, train boolean")
    got = {r.key: r.score / r.n_tokens for r in lm.score(df, carry=["key"]).where("key >= 1500").collect()}
    assert got[1500] == got[1501] > got[1502] + 1


def test_distributions_sum_to_one(spark):
    """Over all known words and the share of one unknown word, after any beginning."""
    lines = ["a b a b a b c", "b a c a b", "c c a b a", "a b c", "the end of the line", "the end of the road"] * 20
    tree = PlainTree(lines)
    assert len(tree.kept) > 3
    for history in ("", "a", "a b", "the end of", "b a b", "road"):
        rows = [(0, history, False)] + [(i + 1, f"{history} {w}", False) for i, w in enumerate(w for w in tree.words if w)]
        rows += [(len(rows), f"{history} unheardof", False)]
        learned = [(1000 + i, t, True) for i, t in enumerate(lines)]
        df = spark.createDataFrame(rows + learned, "key bigint, text string, train boolean")
        got = {r.key: r.score for r in lm.score(df, "train").where("key < 1000").collect()}
        start = sum(math.log10(tree.p(history.split()[:i], w)) for i, w in enumerate(history.split()))
        end = {t: math.log10(tree.p(t.split(), None)) for _, t, _ in rows[1:]}
        total = 10 ** (got[0] - start) + sum(10 ** (got[k] - start - end[t]) for k, t, _ in rows[1:])
        assert total == pytest.approx(1.0, abs=1e-9)


def test_contexts_that_say_nothing_are_not_kept(spark):
    """Words drawn without regard to what stands before give next to no contexts."""
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abcdefgh"), 40)) for _ in range(200)]
    tree = same_as_plain(spark, [(i, t, True) for i, t in enumerate(texts)])
    assert sum(len(c) > 1 for c in tree.kept) <= 12  # of 64 + 512


def test_packed_columns_come_back():
    rng = np.random.default_rng(2)
    for n in (0, 1, 1000):
        columns = [rng.integers(0, 1 << bits, n, dtype=np.uint64) for bits in (1, 9, 30, 63)] + [np.zeros(n, np.uint64)]
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(lm.unpack(lm.pack(*columns)), columns))
        few = [rng.integers(0, 5, n, dtype=np.uint64) for _ in range(3)]
        ordered = [c[np.lexsort(few[::-1])] for c in few]
        back = lm.unpack_sorted(lm.pack_sorted(ordered, columns), 3)
        assert len(back) == 8 and all((a == b).all() for a, b in zip(back, [*ordered, *columns]))


@pytest.mark.parametrize("ranked", [1 << 20, 200])
def test_coded_texts_stay_where_they_are_stored(spark, hot_folder, monkeypatch, ranked):
    """Scores come to the slices: no exchange of the plan moves coded texts or carried columns."""
    monkeypatch.setattr(lm, "FREQUENT", ranked)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = queries.op2_suffix_tree_lm(spark, hot_folder)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    nodes, moved = [plan], []
    for node in nodes:
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange":
            moved.append({node.output().apply(i).name() for i in range(node.output().size())})
    assert moved and all({"slice", "bucket", "data"} <= m for m in moved)
    assert not any(m & {"codes", "carried", "known"} for m in moved)


def test_words_without_a_rank_have_short_codes(spark, hot_folder, monkeypatch):
    """Numbers from the stored counts, not hashes: a few bytes each in what slices send."""
    monkeypatch.setattr(lm, "FREQUENT", 200)
    blocks, wide, plain = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), lm._send

    def watched(batches, spread):
        for batch in plain(batches, spread):
            for data in batch.column("data"):
                blocks.add(1)
                wide.add(sum(int(c.max()) >= 1 << 40 for c in lm.unpack_sorted(data.as_py(), lm.DEPTH + 1)))
            yield batch

    monkeypatch.setattr(lm, "_send", watched)
    assert queries.op2_suffix_tree_lm(spark, hot_folder).count() > 0
    assert blocks.value > 0 and wide.value == 0


def test_next_words_of_a_spread_context_come_packed(spark, hot_folder, monkeypatch):
    """A row per slice, context and part, not per word: its rows grow with the slices only."""
    monkeypatch.setattr(lm, "TASK", 2000)
    counted, spreads, plain, words = spark.sparkContext.accumulator(0), [], lm._spread, lm._next_words
    monkeypatch.setattr(lm, "_spread", lambda *args: spreads.append((plain(*args), args[0].count())) or spreads[-1][0])

    def watched(batches, hot):
        for batch in words(batches, hot):
            counted.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(lm, "_next_words", watched)
    assert queries.op2_suffix_tree_lm(spark, hot_folder).count() > 0
    ((spread, contexts), slices), = spreads
    assert contexts and 0 < counted.value <= slices * len(contexts) * max(lm.PARTS, *spread.words[1].tolist())


def test_order_of_wide_runs():
    rng = np.random.default_rng(5)
    for bits in (4, 16, 17, 20, 24):
        high, low = (rng.integers(0, 1 << 2 * bits, 3000, dtype=np.uint64) for _ in range(2))
        high[:2000], low[:500] = high[0], low[0] ^ rng.integers(0, 8, 500, dtype=np.uint64)
        order = lm._order(high, low, bits)
        assert sorted(order) == list(range(3000))
        assert list(zip(high[order], low[order])) == sorted(zip(high, low))
    none = np.zeros(0, dtype=np.uint64)
    assert len(lm._order(none, none, 20)) == 0


def test_awkward_rows(spark, awkward, nothing):
    out = lm.score(awkward.withColumn("score", F.lit("clash")))
    rows = out.collect()
    assert len(rows) == awkward.count() and "score" in out.columns and out.columns.count("score") == 1
    empty = [r for r in rows if not (r.text or "").strip()]
    assert {r.n_tokens for r in empty} == {1} and all(r.n_known == r.n_tokens for r in rows)
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.text].add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert lm.score(nothing).count() == 0 and set(lm.score(nothing).columns) == set(awkward.columns) | set(lm.OUTPUTS)
    untaught = lm.score(awkward.withColumn("learn", F.lit(None).cast("boolean")), "learn").collect()
    assert len(untaught) == len(rows) and {r.score for r in untaught} == {0.0} == {r.base_score for r in untaught}
