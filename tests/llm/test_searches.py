"""Multi-pattern search, URL rules and exact dedup beyond their queries."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.plain import letter_words
from wavebook.llm import decontaminate, exact_dedup, texts, url_filter


def test_search_finds_every_occurrence():
    rng = random.Random(6)
    for _ in range(60):
        alphabet = rng.choice((["a", "b"], list("abcdefgh"), [f"w{i}" for i in range(300)]))
        draw = lambda n: [rng.choice(alphabet) for _ in range(n)]
        items = [(str(i), " ".join(draw(rng.choice((1, 2, 5, 9, 10, 11, 25))))) for i in range(rng.randint(1, 8))]
        docs = [" ".join(draw(rng.randint(0, 700)) + letter_words(rng.choice(items)[1])) for _ in range(5)]
        tables, ids = decontaminate.build(items)
        hashes, _, _, rows = texts.words(pa.array(docs))
        got = set()
        for p in tables:
            ends, strings = p.search(hashes, rows)
            for e, s in zip(ends.tolist(), strings.tolist()):
                got |= {(e, p.length, ids[i]) for i in p.items[p.item_rows[s] : p.item_rows[s + 1]]}
        want = set()
        for i, text in items:
            words = letter_words(text)
            n = min(10, len(words))
            windows = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
            for d, doc in enumerate(docs):
                own = letter_words(doc)
                want |= {(int(rows[d]) + k + n - 1, n, i) for k in range(len(own) - n + 1) if tuple(own[k : k + n]) in windows}
        assert got == want


def test_positions_are_skipped():
    """Where no pattern word occurs, the search looks at one window end in nine."""
    tables, _ = decontaminate.build([("1", " ".join(f"p{i}" for i in range(10)))])
    looked = []
    inner = tables[0].blocks_at
    tables[0].blocks_at = lambda h, e: looked.append(len(e)) or inner(h, e)
    hashes, _, _, rows = texts.words(pa.array([" ".join(f"x{i}" for i in range(9000))]))
    assert tables[0].search(hashes, rows)[0].tolist() == [] and sum(looked) < 9000 / 8


def test_a_large_benchmark_takes_several_passes(spark):
    rng = random.Random(8)
    draw = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    items = [(i, draw(rng.randint(3, 30))) for i in range(30)]
    docs = [(i, draw(50) + " " + rng.choice(items)[1] + " " + draw(20)) for i in range(40)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    once = sorted(map(str, decontaminate.decontaminate(df, benchmark).collect()))
    often = sorted(map(str, decontaminate.decontaminate(df, benchmark, pass_bytes=600).collect()))
    assert once == often and len(once) == 40


def test_spans_and_awkward_rows(spark, awkward, nothing):
    benchmark = spark.createDataFrame([(7, "ONE two"), (8, None), (None, "quick brown")], "item_id bigint, text string")
    out = decontaminate.decontaminate(awkward.withColumn("spans", F.lit("clash")), benchmark)
    rows = out.collect()
    assert len(rows) == awkward.count() and out.columns.count("spans") == 1
    hit = [r for r in rows if r.contaminated]
    assert {r.doc_id for r in hit} == {10} and {tuple(map(tuple, r.spans)) for r in hit} == {((0, 2),)} and hit[0].item_ids == ["7"]
    assert all(r.n_words == len(letter_words(r.text)) for r in rows)
    assert decontaminate.decontaminate(nothing, benchmark).count() == 0
    assert decontaminate.decontaminate(awkward, benchmark.limit(0)).where("contaminated").count() == 0


def plain_verdict(url, rules, default="allow"):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:end], rest[end:]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, default)


def test_rules_against_a_plain_search(spark, monkeypatch):
    rng = random.Random(10)
    label = lambda: rng.choice(["a", "b", "com", "org", "xn--é", ""])
    part = lambda: rng.choice(["/", "/a", "/a/", "/a/b", "", "/ab?c", "/é#f", "?q/a"])
    rules = list({(".".join(label() for _ in range(rng.randint(1, 3))), rng.choice(["", "/", "/a", "/a/b", "/é"])): rng.choice(["allow", "block"]) for _ in range(40)}.items())
    rules = [(h, p, a) for (h, p), a in rules]
    urls = [rng.choice(["http://", "://", "x://", "", "a"]) + ".".join(label() for _ in range(rng.randint(1, 5))) + part() for _ in range(400)]
    urls += [None] * 3 + ["http://a.com/a"] * 300
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("n", F.lit("clash")).withColumn("Rule", F.lit(1))
    table = spark.createDataFrame(rules, "host string, path string, action string")
    for limit in (url_filter.RULE_BYTES, 0):
        monkeypatch.setattr(url_filter, "RULE_BYTES", limit)
        out = url_filter.url_filter(df, table)
        assert out.columns == ["page_id", "url", "n", "host", "path", "rule", "verdict"]
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
        assert got == {i: plain_verdict(u, rules) for i, u in enumerate(urls)}
    assert url_filter.url_filter(df, table.limit(0), default="block").where("verdict = 'block'").count() == len(urls)
    assert url_filter.url_filter(df.limit(0), table).count() == 0


def test_one_row_of_equal_texts_stays(spark, awkward, nothing):
    out = exact_dedup.exact_dedup(awkward)
    rows = out.collect()
    assert len(rows) == awkward.count() and out.columns.count("kept") == 1
    of = {}
    for r in rows:
        of.setdefault(r.text_sha256, []).append(r)
    for group in of.values():
        assert len({"".join((r.text or "").split()) for r in group}) == 1
        assert [r.group_size for r in group] == [len(group)] * len(group) and sum(r.kept for r in group) == 1
        best = min(group, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        assert {r.keep_id for r in group} == {best.doc_id}
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_a_full_filter_changes_no_result(spark, monkeypatch):
    """With one word of bits nearly every row is a possible repeat."""
    rows = [(i, f"text {i % 700 if i % 3 else 'hot'}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(exact_dedup.exact_dedup(df).collect())
    monkeypatch.setattr(exact_dedup, "FILTER_WORDS", 1)
    assert sorted(exact_dedup.exact_dedup(df).collect()) == want
    assert np.sum([r.kept for r in want]) == len({t for _, t in rows})


def test_single_rows_are_not_shuffled(spark):
    """Texts without a repeat pass by: only possible repeats meet in an exchange."""
    rows = [(i, f"text {i}") for i in range(2000)] + [(5000, "text 7")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    digests = df.select(F.unhex(F.sha2("text", 256)).alias("d"))
    assert exact_dedup.seen_again(digests, "d").count() <= 3
