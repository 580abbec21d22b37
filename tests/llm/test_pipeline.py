"""Every stage of the pipeline on its own input, against a plain version."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.plain import blank_words, components, letter_words, shingles
from tests.llm.test_mixing import plain_targets
from wavebook.llm import near_dedup
from wavebook.llm.common import materialise
from wavebook.llm.language import ANY_LETTER


@pytest.mark.parametrize("stage", ["near dedup", "mixing", "sharding"])
def test_rows_keep_their_numbers_when_later_reads_are_split_otherwise(spark, monkeypatch, tmp_path, stage):
    """As after an executor is lost between a stage's decision and the join that brings it back."""
    rows = [(i, f"text {i} " + f"w{i} " * (i % 7 + 6), "en", f"src{i % 3}") for i in range(60)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(6).write.parquet(path)
    run = dict(corpus_pipeline.STAGES)[stage]
    want = sorted(map(str, rows_of(run(spark, spark.read.parquet(path), ""))))
    module, name = {
        "near dedup": (corpus_pipeline.near_dedup, "near_dedup"), "mixing": (corpus_pipeline.mixing, "mix"),
        "sharding": (corpus_pipeline.resharding, "reshard"),
    }[stage]
    operator = getattr(module, name)
    settings = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}

    def decided(*args, **kwargs):
        out = materialise(operator(*args, **kwargs))
        for k, v in settings.items():
            spark.conf.set(k, v)
        return out

    monkeypatch.setattr(module, name, decided)
    try:
        got = run(spark, spark.read.parquet(path), "")
        assert sorted(map(str, rows_of(got))) == want
    finally:
        for k in settings:
            spark.conf.unset(k)


NAMES = [
    "file", "place", "copies", "was", "score", "langs", "lang_pred", "n_words", "spans", "contaminated", "class_id", "kept",
    "size", "shard", "slot", "low", "high", "_s", "_row", "_keep", "_size", "_shard", "_doc_0", "_new_size", "word", "digest",
]


@pytest.mark.parametrize("upper", [False, True])
@pytest.mark.parametrize("stored", [False, True])
def test_columns_of_any_name_come_through(spark, tmp_path, upper, stored):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    names = [n.upper() if upper else n for n in NAMES]
    docs = docs.withColumns({n: F.concat(F.lit(f"MINE {n} "), F.col("doc_id").cast("string")) for n in names})
    if stored:
        docs.write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        rows = rows_of(out)
        replaced = {"size", "shard", "slot"} if n == 4 else set()
        mine = [c for c in names if c.lower() not in replaced]
        assert rows and all(r[c] == f"MINE {c} {r['doc_id']}" for r in rows for c in mine), name
        assert n == 4 or out.columns == docs.columns


def test_stages_that_read_files_store_no_texts(spark, monkeypatch):
    def fail(df):
        raise AssertionError("rows are stored")

    monkeypatch.setattr(corpus_pipeline, "store", fail)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    numbered = corpus_pipeline._Numbered(docs).rows
    assert numbered.select("file", "place").distinct().count() == docs.count()


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def similar_pairs(texts, low):
    """Pairs of different texts with at least so much in common, found by their shingles."""
    sets = [shingles(t) for t in texts]
    by = collections.defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    pairs = {(i, j) for group in by.values() if len(group) < 400 for i in group for j in group if i < j}
    return {p for p in pairs if sum((sets[p[0]] & sets[p[1]]).values()) / sum((sets[p[0]] | sets[p[1]]).values()) >= low}


def check_language(before, after, **_):
    assert after == [r for r in before if r["text"] and ANY_LETTER.search(r["text"])]


def check_near_dedup(before, after, **_):
    texts = sorted({r["text"] for r in before})
    place = {t: i for i, t in enumerate(texts)}
    kept = {place[r["text"]] for r in after}
    sure, possible = similar_pairs(texts, 0.83), similar_pairs(texts, 0.76)
    assert not [p for p in sure if p[0] in kept and p[1] in kept]
    # A text goes only if another one of its chain stays, and one row of a text stays.
    chain = components(range(len(texts)), possible)
    assert {chain[i] for i in range(len(texts))} == {chain[i] for i in kept}
    assert len(after) == len(kept)
    alone = collections.Counter(chain.values())
    assert {i for i in range(len(texts)) if alone[chain[i]] == 1} <= kept
    first = {}
    for r in before:
        first[r["text"]] = min(first.get(r["text"], r["doc_id"]), r["doc_id"])
    assert all(r["doc_id"] == first[r["text"]] for r in after)


def check_decontamination(before, after, benchmark, **_):
    windows = set()
    for text in benchmark:
        words = letter_words(text)
        if words:
            size = min(10, len(words))
            windows |= {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
    sizes = {len(w) for w in windows}

    def clean(text):
        words = letter_words(text)
        return not any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1))

    assert after == [r for r in before if clean(r["text"])]


def check_mixing(before, after, **_):
    copies = collections.Counter(r["doc_id"] for r in after)
    size = {r["doc_id"]: len(blank_words(r["text"])) for r in before}
    source = {r["doc_id"]: r["source"] for r in before}
    assert set(copies) <= set(size) and max(copies.values()) <= 2
    of_source, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for d, n in size.items():
        of_source[source[d]] += n
        taken[source[d]] += n * copies[d]
        largest[source[d]] = max(largest[source[d]], n)
    for s, target in plain_targets(of_source).items():
        assert abs(taken[s] - target) <= largest[s] + 0.01 * target + 10
    original = {r["doc_id"]: r for r in before}
    assert all(r == original[r["doc_id"]] for r in after)


def check_sharding(before, after, **_):
    drop = ("size", "shard", "slot")
    key = lambda r: str(sorted(r.items(), key=str))
    assert sorted(({k: v for k, v in r.items() if k not in drop} for r in after), key=key) == sorted(before, key=key)
    slots, filled = collections.defaultdict(list), collections.Counter()
    for r in after:
        slots[r["shard"]].append(r["slot"])
        filled[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share, largest = sum(filled.values()) / 40, max(r["size"] for r in after)
    assert all(abs(filled[s] - share) <= largest for s in range(40))


CHECKS = [check_language, check_near_dedup, check_decontamination, check_mixing, check_sharding]


def stages(spark, folder, docs, tmp_path, order=("doc_id",)):
    benchmark = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for n, ((name, stage), check) in enumerate(zip(corpus_pipeline.STAGES, CHECKS)):
        out = stage(spark, docs, folder)
        assert n == 4 or out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{n}")
        written = spark.read.parquet(f"{tmp_path}/{n}")
        check(rows_of(docs.orderBy(*order)), rows_of(written.orderBy(*order)), benchmark=benchmark)
        docs = written


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01", "hot"])
def test_stages(spark, hot_folder, tmp_path, folder):
    folder = hot_folder if folder == "hot" else folder
    stages(spark, folder, spark.read.parquet(f"{folder}/documents.parquet"), tmp_path)


def test_run_is_the_stages_one_after_the_other(spark):
    folder = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert rows.columns == [*docs.columns, "size", "shard", "slot"] and 0 < rows.count() <= 2 * docs.count()


def test_clean_documents_stay(spark):
    """Texts that are like no other and in no benchmark pass the three filters."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, folder)
    assert kept.count() > 0.6 * docs.count()


def test_awkward_rows(spark, awkward, nothing):
    folder = "/root/testdata/sf0.001"
    for docs in (awkward, nothing):
        columns = docs.columns
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            assert n == 4 or out.columns == columns, name
            docs = out.checkpoint()
        assert docs.columns == [c for c in columns if c != "size"] + ["size", "shard", "slot"]
        assert docs.count() == 0 if columns == nothing.columns and docs.count() == 0 else docs.count() > 5


def test_near_dedup_takes_five_words_and_four_fifths():
    assert near_dedup.SHINGLE == 5 and near_dedup.SIMILARITY == 0.8
