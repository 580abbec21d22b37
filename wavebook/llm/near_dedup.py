"""Near-duplicate documents by improved consistent weighted sampling.

Every text is a weighted set of shingles of five words; a shingle weighs its number
of occurrences times an inverse document frequency. Improved consistent weighted
sampling draws one shingle per hash, the same for two texts with a chance equal to
their weighted Jaccard similarity. Bands of samples bring candidates together,
which are then verified by the weighted Jaccard similarity of the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wavebook.llm import texts
from wavebook.llm.common import join_counted, shielded, store

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 20
ROWS_PER_BAND = 5

# Samples in all. Texts that agree in fewer than a share of them are not compared: texts of
# the least similarity agree in 0.8 on the average, and 3.5 deviations less is 0.7.
SAMPLES = 200
AGREEMENT = 0.7

# Document frequencies are counted in hashed cells, so the table is that wide for any corpus.
CELL_BITS = 17
CELLS = 1 << CELL_BITS

# The inverse document frequency is scaled to between 1 and this, in so many levels. A wide
# scale would tear a large family of near copies apart: what its members share is frequent
# just because there are many of them.
IDF_TOP = 1.25
LEVELS = 8

# Quantiles of the random variables of the sampling.
DRAW_BITS = 16

# Leaders of a bucket grow by this factor from round to round.
LEADERS = 64

# Members of a bucket whose samples are compared with so many of its leaders' in one task.
CHUNK_MEMBERS = 4096

# Bytes of text compared with one leader in one task.
CHUNK_BYTES = 8 << 20

# Bytes of text whose shingles are held at a time.
SLICE_BYTES = 3 << 20

# Words of the filter that says which texts have a candidate; 16 MB of bits.
FILTER_WORDS = 1 << 21

_draws = np.random.Generator(np.random.PCG64(5))
_GAMMA = _draws.gamma(2.0, 1.0, (2, 1 << DRAW_BITS)).astype(np.float32)
DRAW_R = np.maximum(_GAMMA[0], np.float32(1e-3))
DRAW_LOG_C = np.log(np.maximum(_GAMMA[1], np.float32(1e-6)))
DRAW_BETA = _draws.random(1 << DRAW_BITS, dtype=np.float32)
SEEDS = _draws.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LEVEL_WEIGHTS = np.linspace(1.0, IDF_TOP, LEVELS).astype(np.float32)


def sampled(log_weight: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log a, t) of the sampling for shingles with these log weights and draws."""
    r, beta = DRAW_R[draw], DRAW_BETA[draw]
    t = np.floor(log_weight / r + beta)
    return DRAW_LOG_C[draw] - r * (t - beta + np.float32(1.0)), t


def _orderable(log_a: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the floats."""
    bits = log_a.astype(np.float32).view(np.int32)
    return np.where(bits < 0, ~bits, bits | np.int32(-(1 << 31))).view(np.uint32)


# For a shingle that occurs once, log a depends on its level and its draw only.
_ONCE = np.stack([
    _orderable(sampled(np.full(1 << DRAW_BITS, np.log(w), np.float32), np.arange(1 << DRAW_BITS))[0])
    for w in LEVEL_WEIGHTS
]).ravel().astype(np.uint64) << np.uint64(32)


def weighted_sets(column: pa.Array, levels: np.ndarray):
    """(shingles, levels, counts, rows): the distinct shingles of every text, sorted."""
    hashes, _, _, word_rows = texts.words(column)
    runs, run_rows = texts.shingles(hashes, word_rows, SHINGLE)
    found, times = [], []
    for low, high in zip(run_rows, run_rows[1:]):
        own, n = np.unique(runs[low:high], return_counts=True)
        found.append(own)
        times.append(n)
    rows = np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64)))
    shingles = np.concatenate(found) if found else np.zeros(0, np.uint64)
    counts = np.concatenate(times) if times else np.zeros(0, np.int64)
    return shingles, levels[_cell(shingles)], counts, rows


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def bands(shingles: np.ndarray, levels: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, samples) of the non-empty rows: a key per band, from its samples, and one
    byte of every sample."""
    starts = rows[:-1][np.diff(rows) > 0]
    ends = rows[1:][np.diff(rows) > 0]
    keys = np.zeros((len(starts), BANDS), dtype=np.uint64)
    samples = np.zeros((len(starts), SAMPLES), dtype=np.uint8)
    if not len(starts):
        return keys, samples
    offset = levels.astype(np.int64) << DRAW_BITS
    repeated = np.flatnonzero(counts > 1)
    log_repeated = np.log(LEVEL_WEIGHTS[levels[repeated]] * counts[repeated]).astype(np.float32)
    log_weight = np.log(LEVEL_WEIGHTS[levels] * counts).astype(np.float32)
    # A few thousand rows' worth of shingles at a time stay in the processor's cache.
    cuts = np.unique(np.concatenate((np.searchsorted(starts, np.arange(0, rows[-1], 1 << 15)), [0, len(starts)])))
    for first, last in zip(cuts, cuts[1:]):
        low, high = starts[first], ends[last - 1]
        own, base = shingles[low:high], offset[low:high]
        place = np.arange(high - low, dtype=np.uint64)
        some = slice(*np.searchsorted(repeated, (low, high)))
        again, log_again = repeated[some] - low, log_repeated[some]
        for k, seed in enumerate(SEEDS):
            draw = ((own * seed) >> np.uint64(64 - DRAW_BITS)).astype(np.int64)
            packed = _ONCE[base + draw]
            if len(again):
                log_a, _ = sampled(log_again, draw[again])
                packed[again] = _orderable(log_a).astype(np.uint64) << np.uint64(32)
            packed |= place
            least = np.minimum.reduceat(packed, starts[first:last] - low)
            winner = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            _, t = sampled(log_weight[low:high][winner], draw[winner])
            sample = texts.mix(own[winner] + t.astype(np.int64).astype(np.uint64) * np.uint64(texts.BASE))
            samples[first:last, k] = sample >> np.uint64(56)
            b = k // ROWS_PER_BAND
            if b < BANDS:
                keys[first:last, b] = texts.mix(keys[first:last, b] + sample + np.uint64(k))
    return keys, samples


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted shingles, weights)."""
    _, in_a, in_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][in_a], b[1][in_b]).sum())
    whole = float(a[1].sum() + b[1].sum()) - shared
    return shared / whole if whole else 0.0


def idf_levels(df: DataFrame, text: str) -> np.ndarray:
    """The level of the inverse document frequency of every cell, from all texts.

    Each task adds up its texts; what it sends grows with its cells, not its rows.
    One number per cell reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS + 1, dtype=np.int64)
        for batch in (part for whole in batches for part in texts.slices(whole, 0, SLICE_BYTES)):
            hashes, _, _, word_rows = texts.words(batch.column(0))
            runs, rows = texts.shingles(hashes, word_rows, SHINGLE)
            # A cell counts once for a text.
            key = np.sort(np.repeat(np.arange(batch.num_rows), np.diff(rows)) << CELL_BITS | _cell(runs))
            new = np.append(True, key[1:] != key[:-1])[: len(key)]
            total[:CELLS] += np.bincount(key[new] & (CELLS - 1), minlength=CELLS)
            total[CELLS] += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["cell", "n"])

    counted = df.select(F.col(text).alias("text")).mapInArrow(run, "cell int, n bigint")
    found = counted.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CELLS + 1)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    idf = np.log((1 + counts[CELLS]) / (1 + counts[:CELLS]))
    scaled = idf / max(np.log(1 + counts[CELLS]), 1e-9) * (LEVELS - 1)
    return np.clip(np.rint(scaled), 0, LEVELS - 1).astype(np.int8)


def _sign(batch: pa.RecordBatch, text: str, levels) -> dict[str, pa.Array]:
    sets = weighted_sets(batch.column(batch.schema.get_field_index(text)), levels.value)
    rows = sets[3]
    some = np.diff(rows) > 0
    keys, samples = bands(*sets)
    offsets = np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32)
    place = pa.array(np.cumsum(some) - 1, mask=~some)
    return {
        "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64))),
        "samples": pa.array([s.tobytes() for s in samples], pa.binary()).take(place),
    }


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leader, member): the leader of another class in the bucket that a member agrees with in
    most samples, if they are enough; rows come by bucket and chunk, leaders first."""
    held = None
    for batch in batches:
        bucket, chunk, key, kind = (batch.column(i).to_numpy() for i in (0, 1, 3, 5))
        leads = batch.column(2).to_numpy(zero_copy_only=False)
        data, _ = texts.raw(batch.column(4))
        samples = data.reshape(-1, SAMPLES)
        if held is not None:
            now = (bucket, chunk, key, kind, leads, samples)
            bucket, chunk, key, kind, leads, samples = (np.concatenate(x) for x in zip(held, now))
        new = np.append(True, (bucket[1:] != bucket[:-1]) | (chunk[1:] != chunk[:-1]))
        begins = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        count = np.bincount(group[leads], minlength=len(begins))
        # Leaders are among the members, too; nobody meets his own class.
        member = np.flatnonzero(~leads)
        member = member[count[group[member]] > 0]
        # Members of a batch with all leaders of their bucket, a bounded number at a time.
        pairs = count[group[member]]
        cuts = np.append(np.unique(np.searchsorted(np.cumsum(pairs), np.arange(0, int(pairs.sum()) + 1, 1 << 16))), len(member))
        for low, high in zip(cuts, cuts[1:]):
            own, times = member[low:high], pairs[low:high]
            if not len(own):
                continue
            m = np.repeat(own, times)
            first = np.repeat(begins[group[own]], times)
            starts = np.cumsum(times) - times
            l = first + np.arange(len(m)) - np.repeat(starts, times)
            agree = (samples[m] == samples[l]).sum(axis=1)
            agree[kind[m] == kind[l]] = -1
            most = np.maximum.reduceat(agree, starts)
            best = np.minimum.reduceat(np.where(agree == np.repeat(most, times), l, len(key)), starts)
            like = most >= AGREEMENT * SAMPLES
            yield pa.RecordBatch.from_arrays([pa.array(key[best[like]]), pa.array(key[own[like]])], names=["leader", "member"])
        # The leaders of the last bucket, whose members may go on.
        last = np.arange(begins[-1], len(key))
        last = last[leads[last]]
        held = (bucket[last], chunk[last], key[last], kind[last], leads[last], samples[last])


class _Leads:
    """The texts of a bucket that others are compared with, as postings of their shingles."""

    def __init__(self):
        self.keys: list[int] = []
        self.kinds: list[int] = []
        self.sets: list[tuple[np.ndarray, np.ndarray]] = []
        self.parent: dict[int, int] = {}

    def kind(self, kind: int) -> int:
        """The class that a class has become part of."""
        while (above := self.parent.get(kind, kind)) != kind:
            kind = above
        return kind

    def close(self) -> None:
        shingles = np.concatenate([s for s, _ in self.sets])
        order = np.argsort(shingles)
        self.shingles = shingles[order]
        self.of = np.repeat(np.arange(len(self.sets)), [len(s) for s, _ in self.sets])[order]
        self.weights = np.concatenate([w for _, w in self.sets])[order].astype(np.float64)
        self.total = np.array([float(w.sum()) for _, w in self.sets])
        self.sets = []

    def similar(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The weighted Jaccard similarity of a text to every lead."""
        low, high = (np.searchsorted(self.shingles, shingles, side) for side in ("left", "right"))
        times = high - low
        at = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        shared = np.bincount(self.of[at], np.minimum(self.weights[at], np.repeat(weights, times)), len(self.total))
        return shared / np.maximum(self.total + float(weights.sum()) - shared, 1e-9)


def _link(batches: Iterator[pa.RecordBatch], levels, threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, b, similarity): links between the classes of a bucket, as many as connect them.

    Rows come by bucket and chunk, leads first. Every member is compared with every lead
    of another class by their whole texts; two classes with a link are one from then on, so a
    task returns fewer links than it has texts.
    """
    group, leads, closed = None, _Leads(), False
    for batch in (part for whole in batches for part in texts.slices(whole, 5, SLICE_BYTES)):
        found: tuple[list, list, list] = ([], [], [])
        shingles, level, counts, rows = weighted_sets(batch.column(5), levels.value)
        weights = (LEVEL_WEIGHTS[level] * counts).astype(np.float64)
        columns = zip(*(batch.column(i).to_pylist() for i in range(5)), rows, rows[1:])
        for bucket, chunk, lead, key, kind, low, high in columns:
            if (bucket, chunk) != group:
                group, leads, closed = (bucket, chunk), _Leads(), False
            own = (shingles[low:high], weights[low:high])
            if lead:
                leads.keys.append(key)
                leads.kinds.append(kind)
                leads.sets.append(own)
                continue
            if not leads.keys:
                continue
            if not closed:
                leads.close()
                closed = True
            similar = leads.similar(*own)
            for at in np.flatnonzero(similar >= threshold):
                ours, theirs = leads.kind(kind), leads.kind(leads.kinds[at])
                if ours != theirs:
                    leads.parent[max(ours, theirs)] = min(ours, theirs)
                    for values, value in zip(found, (leads.keys[at], key, float(similar[at]))):
                        values.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())],
            names=["a", "b", "similarity"],
        )


def _verify(batches: Iterator[pa.RecordBatch], levels) -> Iterator[pa.RecordBatch]:
    """Rows come by leader, the leader's own text first: compare each text with it."""
    leader, of = None, None
    for batch in (part for whole in batches for part in texts.slices(whole, 3)):
        sets = weighted_sets(batch.column(3), levels.value)
        weights = LEVEL_WEIGHTS[sets[1]] * sets[2]
        out = ([], [], [])
        columns = zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), sets[3], sets[3][1:])
        for lead, chunk, member, low, high in columns:
            own = (sets[0][low:high], weights[low:high])
            if member is None:
                leader, of = own, (lead, chunk)
                continue
            if of != (lead, chunk):
                raise ValueError("a group without its leader")
            out[0].append(lead)
            out[1].append(member)
            out[2].append(similarity(leader, own))
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
            names=["leader", "member", "similarity"],
        )


def _possible(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key may be listed: a bit filter of a fixed size decides.

    It spares the shuffle of texts that have no candidate; the join that follows
    is exact.
    """
    word = F.pmod(F.xxhash64(F.col(key)), F.lit(FILTER_WORDS))
    bit = F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(64)).cast("int")
    )
    listed = ids.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    return (
        df.withColumn("_word", word).join(F.broadcast(listed), "_word")
        .where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")
    )


def candidate_texts(docs: DataFrame, buckets: DataFrame) -> DataFrame:
    """(key, text, bytes) of the texts in a bucket with others, stored.

    ``docs`` has a row per document; rows of one key are equal and merged before the
    shuffle.
    """
    involved = buckets.select("key").distinct()
    once = _possible(docs, involved, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("bytes").alias("bytes"))
    return store(once.join(involved, "key", "left_semi"))


def verified(near: DataFrame, pairs: DataFrame, levels) -> DataFrame:
    """(leader, member, similarity) of candidate pairs, both given by their text keys. ``pairs`` is stored.

    Texts go to their leaders; the texts of one leader are dealt into chunks of
    bounded size, each with a copy of the leader's text.
    """
    weighed = pairs.join(near.select(F.col("key").alias("member"), "bytes"), "member")
    chunks = store(
        weighed.groupBy("leader").agg(F.sum("bytes").alias("bytes")).select(
            "leader", F.expr(f"int(1 + bytes div {CHUNK_BYTES})").alias("chunks")
        ),
        pairs.count(),
    )
    # A leader of very many texts is a skewed key here, which adaptive joins split.
    placed = pairs.join(chunks, "leader").withColumn("chunk", F.pmod(F.xxhash64("member"), F.col("chunks")).cast("int"))
    members = placed.join(near.select(F.col("key").alias("member"), "text"), "member").select(
        "leader", "chunk", "member", "text"
    )
    leaders = chunks.join(near.select(F.col("key").alias("leader"), "text"), "leader").select(
        "leader", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.lit(None).cast("bigint").alias("member"), "text",
    )
    together = leaders.unionByName(members).repartition("leader", "chunk").sortWithinPartitions(
        "leader", "chunk", F.col("member").asc_nulls_first()
    )
    return together.mapInArrow(partial(_verify, levels=levels), "leader bigint, member bigint, similarity double")


def find_links(docs: DataFrame, signed: DataFrame, levels, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity) of similar texts, and (key, class) of linked ones, by rounds of leaders in every bucket.

    ``signed`` has (key, bands, samples), one row per text. The first leader of a bucket is the
    text that meets most others; round ``r`` has about ``LEADERS ** r`` leaders, the
    further ones chosen by a hash, so a bucket of ``n`` kinds of text is done after a
    logarithm of ``n`` rounds. A member proposes one leader a round, so a round has no more
    pairs than the buckets have members. Stored every round. In the end all texts of a bucket that
    are still in different classes are compared, see ``_across``: the rounds only make
    that fewer.
    """
    spark = docs.sparkSession
    left = signed.select(F.explode("bands").alias("bucket"), "key", F.col("key").alias("class"))
    links = spark.createDataFrame([], "a bigint, b bigint, similarity double")
    named = spark.createDataFrame([], "key bigint, class bigint")
    near, first_shared, most = None, None, 1
    # Of the members of all buckets, and so of what a round stores of them.
    rows = signed.count() * BANDS
    while True:
        sizes = left.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        # Both sides are stored or counted, so adaptive joins can split a bucket with very many texts.
        shared = store(left.join(store(sizes, rows), "bucket").withColumn("leads", F.least("n", F.lit(most))), rows)
        rows = shared.count()
        if not rows:
            break
        if near is None:
            near, first_shared = candidate_texts(docs, shared), shared
        every = F.ceil(F.col("n") / F.lit(most))
        chosen = F.pmod(F.xxhash64("key", F.lit(most)), every) == 0
        first = _most_met(shared)
        leaders = (
            shared.where(chosen).select("bucket", F.col("key").alias("leader")).unionByName(first).distinct()
            if most > 1 else first
        )
        leaders = store(leaders, rows)
        pairs = store(_candidates(shared, leaders, signed), rows)
        if not pairs.isEmpty():
            similar = store(verified(near, pairs, levels).where(F.col("similarity") >= threshold))
            links, named = _joined(links, named, similar.select(F.col("leader").alias("a"), F.col("member").alias("b"), "similarity"))
        # A member of a leader's class, by whatever links, leaves this bucket with it, which
        # keeps a large family from meeting over and over; what it misses is met in the end.
        left = store(_others(shared.select("bucket", "key"), leaders, named), rows)
        most *= LEADERS
    if first_shared is None:
        return links, named
    return _joined(links, named, store(_across(first_shared, named, near, levels, threshold)))


def _joined(links: DataFrame, named: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with those just found, and the classes of all."""
    if more.isEmpty():
        return links, named
    links = links.unionByName(more)
    return links, classes(links)


def _across(shared: DataFrame, named: DataFrame, near: DataFrame, levels, threshold: float) -> DataFrame:
    """(a, b, similarity): links between texts of one bucket that are in different classes.

    All texts but those of a bucket's largest class lead, so every two texts of different
    classes meet. A bucket's texts are dealt into chunks and its leads into parts, of
    bounded bytes, and every chunk meets every part in one task, which returns links only:
    neither pairs nor candidates are ever rows. Two texts alone in a bucket have met before.
    """
    found = store(
        shared.select("bucket", "key").join(named, "key", "left")
        .select("bucket", "key", F.coalesce("class", "key").alias("class"))
        .join(near.select("key", "bytes"), "key")
    )
    kinds = found.groupBy("bucket", "class").agg(F.count("*").alias("times"), F.sum("bytes").alias("bytes"))
    sizes = store(
        kinds.groupBy("bucket").agg(
            F.sum("times").alias("n"), F.count("*").alias("kinds"), F.sum("bytes").alias("all"),
            F.max(F.struct("times", "class", "bytes")).alias("largest"),
        )
        .where("kinds > 1 and n > 2")
        .select(
            "bucket", F.col("largest.class").alias("most"), F.expr(f"int(1 + all div {CHUNK_BYTES})").alias("chunks"),
            F.expr(f"int(1 + (all - largest.bytes) div {CHUNK_BYTES})").alias("parts"),
        )
    )
    apart = found.join(sizes, "bucket").withColumn("leads", F.col("class") != F.col("most"))
    at = _grid(F.col("chunks"), F.col("parts"), F.col("leads"))
    rows = apart.select("bucket", F.explode(at).alias("at"), "key", "class").select("bucket", "at.chunk", "at.lead", "key", "class")
    whole = rows.join(near.select("key", "text"), "key").select("bucket", "chunk", "lead", "key", "class", "text")
    placed = whole.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", F.col("lead").desc())
    return placed.mapInArrow(partial(_link, levels=levels, threshold=threshold), "a bigint, b bigint, similarity double")


def _grid(chunks: Column, parts: Column, leads: Column) -> Column:
    """Places (chunk, lead) of a row: as a member with every part of the leads, as a lead with every chunk."""
    chunk = F.pmod(F.xxhash64("key"), chunks).cast("int")
    part = F.pmod(F.xxhash64("key", F.lit("part")), parts).cast("int")
    members = F.transform(
        F.sequence(F.lit(0), parts - 1), lambda p: F.struct((chunk * parts + p).alias("chunk"), F.lit(False).alias("lead"))
    )
    leading = F.transform(
        F.sequence(F.lit(0), chunks - 1), lambda c: F.struct((c * parts + part).alias("chunk"), F.lit(True).alias("lead"))
    )
    return F.when(leads, F.concat(members, leading)).otherwise(members)


def _candidates(shared: DataFrame, leaders: DataFrame, signed: DataFrame) -> DataFrame:
    """(leader, member), the smaller key first: texts of a bucket with the leader they agree with most.

    A bucket's ``n`` members are dealt into chunks, its leaders, about ``leads``, into
    parts, and every chunk meets every part; a member leaves the task with one leader
    at most, of another class, whose samples agree.
    """
    chunks, parts = (F.expr(f"int(1 + {c} div {CHUNK_MEMBERS})") for c in ("n", "leads"))
    led = leaders.select("bucket", F.col("leader").alias("key"), F.lit(True).alias("leader"))
    dealt = shared.join(led, ["bucket", "key"], "left")
    at = _grid(chunks, parts, F.col("leader"))
    rows = dealt.select("bucket", F.explode(at).alias("at"), "key", "class").select("bucket", "at.chunk", "at.lead", "key", "class")
    with_samples = rows.join(signed.select("key", "samples"), "key").select("bucket", "chunk", "lead", "key", "samples", "class")
    placed = with_samples.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", F.col("lead").desc())
    met = placed.mapInArrow(_agree, "leader bigint, member bigint")
    return met.select(F.least("leader", "member").alias("leader"), F.greatest("leader", "member").alias("member")).distinct()


def _most_met(shared: DataFrame) -> DataFrame:
    """(bucket, leader): of every bucket the text that meets the most texts in all its buckets.

    That is the middle of a family, to which more members are similar than to others.
    """
    meetings = shared.groupBy("key").agg(F.sum("n").alias("meetings"))
    ranked = shared.select("bucket", "key").join(meetings, "key")
    best = F.max(F.struct("meetings", "key"))
    return ranked.groupBy("bucket").agg(best.alias("best")).select("bucket", F.col("best.key").alias("leader"))


def _others(members: DataFrame, leaders: DataFrame, named: DataFrame) -> DataFrame:
    """(bucket, key, class) of members in no class that a leader of their bucket has."""
    found = members.join(named, "key", "left").select("bucket", "key", F.coalesce("class", "key").alias("class"))
    led = leaders.select("bucket", F.col("leader").alias("key")).join(named, "key", "left")
    return found.join(
        led.select("bucket", F.coalesce("class", "key").alias("class")).distinct(), ["bucket", "class"], "left_anti"
    ).select("bucket", "key", "class")


def classes(links: DataFrame) -> DataFrame:
    """(key, class): the smallest key each key is linked to, over any number of links; stored.

    Smallest labels spread along links, and every label is replaced by its own
    label, so long chains halve with every round.
    """
    rows = 2 * links.count()
    edges = store(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), rows)
    labels = store(edges.groupBy(F.col("a").alias("key")).agg(F.min(F.least("a", "b")).alias("class")), rows)
    while True:
        near = edges.join(labels, edges.b == labels.key).groupBy("a").agg(F.min("class").alias("near"))
        jump = labels.select(F.col("key").alias("at"), F.col("class").alias("next"))
        lower = labels.join(jump, F.col("class") == F.col("at")).join(near, F.col("key") == F.col("a"))
        new = store(
            lower.select("key", F.least("next", "near").alias("class"), (F.least("next", "near") < F.col("class")).alias("moved")),
            rows,
        )
        changed = new.where("moved").limit(1).count()
        labels = new.select("key", "class")
        if not changed:
            return labels


OUTPUTS = ["class_id", "class_size", "kept"]


@shielded("text", "id_column", outputs=OUTPUTS)
def near_dedup(
    df: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    carry: list[str] | None = None,
    threshold: float = SIMILARITY,
) -> DataFrame:
    """Add the class of near-equal texts to every row.

    Returns the ``carry`` columns (all by default) with ``class_id``, the smallest
    id in the row's class; ``class_size``; and ``kept``, true for one row of a
    class, the first with the smallest id. Texts with the same words in the same order are
    in one class; texts are linked if their weighted Jaccard similarity reaches
    ``threshold``, and classes are what links connect.

    Each bucket of a band compares its texts with one of them, the leader; those
    that are not in its class then go on to a further round with more leaders, until
    no bucket has two texts left. In the end texts of a bucket that are in different classes
    are all compared by their whole texts, in tasks that return no more links than they have
    texts.

    Words are runs of letters, digits and characters beyond ASCII, A-Z folded; a
    text of fewer than five words is one shingle. A null text counts as empty;
    texts without words are one class only if they are equal. Rows with a missing
    id take part, the id of their class being that of others if any has one. An
    empty table gives no rows. Columns of any name are carried; those of the outputs'
    names are replaced. The carried columns are stored once in the shared checkpoint folder.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    spark = df.sparkSession
    levels = spark.sparkContext.broadcast(idf_levels(df, text))
    keyed = df.select(*carry, F.col(id_column).alias("id"), F.xxhash64(whole).alias("key"), whole.alias("text"))
    added = {"bands": "array<bigint>", "samples": "binary"}
    signed = texts.map_batches(keyed, added, partial(_sign, text="text", levels=levels), "text", drop=("text",), limit=SLICE_BYTES)
    rows = store(signed.withColumn("rid", F.monotonically_increasing_id()))
    # Equal texts have equal keys and bands; they are one text from here on.
    distinct = store(
        rows.groupBy("key").agg(
            F.first("bands").alias("bands"), F.first("samples").alias("samples"), F.count("*").alias("rows")
        )
    )
    docs = df.select(F.xxhash64(whole).alias("key"), whole.alias("text"), F.octet_length(whole).cast("bigint").alias("bytes"))
    _, linked = find_links(docs, distinct, levels, threshold)
    of_text = distinct.join(linked, "key", "left").select("key", F.coalesce("class", "key").alias("class"), "rows")
    total = rows.count()
    named = store(join_counted(rows.drop("bands", "samples"), store(of_text, total), ["key"], "rows", total))
    best = F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.col("rid").alias("r")))
    groups = store(named.groupBy("class").agg(best.alias("best"), F.count("*").alias("class_size")), total)
    joined = join_counted(named, groups, ["class"], "class_size", total)
    return joined.select(*carry, F.col("best.i").alias("class_id"), "class_size", (F.col("rid") == F.col("best.r")).alias("kept"))
