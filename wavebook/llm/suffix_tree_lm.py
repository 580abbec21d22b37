"""A probabilistic suffix tree over words.

States are contexts of up to three words. Every run of a context and a next word that
the training texts have twice is counted, whatever the size of the corpus. A context is
retained if its distribution of the next word diverges enough from that of the longest
retained context that is a suffix of it. Distributions are smoothed by taking half a
count from every next word kept and giving what is free to the shorter context. A token
is scored in the longest retained context before it.

All suffixes of a context end with the same word. So texts are cut into slices, a slice
sends its distinct runs of four words, packed, to the bucket of the last word of their
context, and the bucket counts all lengths, tests the contexts and returns the counts of
the retained ones for each run. Words with more runs than a task should take are spread by the
word before them, and pairs by the one before that; their next words, counted in a
grouping of their own, then go along to each of their buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from wavebook.llm import texts
from wavebook.llm.common import shielded, store, store_by
from wavebook.session import literal_table

DEPTH = 3

# Occurrences that a context and a run need, at any size of the corpus.
LEAST = 2

# Counts are sent doubled less one, so this is not to be changed alone.
DISCOUNT = 0.5

# Nats that a context must gain on the training tokens, for each next word it keeps.
DIVERGENCE = 3.0

# Words with short codes and broadcast counts: a bound on memory. The others have longer
# codes and joined counts, and the same scores.
FREQUENT = 1 << 20

# Tokens for a bucket, and the most words or pairs that are spread over several.
TASK = 1 << 19
MOST_HOT = 2048

# Parts in which the next words of a spread context are gathered, or as many as the buckets it is spread over.
PARTS = 16

END = np.uint64(0x5D1B5D1B00000E0D)
BASE = np.uint64(texts.BASE)

# Codes: nothing before the text, a word that training has less than twice, then words
# by rank; words without a rank by their number in the stored counts, from LISTED on. Until these
# are joined, hashes of such words have the highest bit, and a stored slice has their place in
# its own list, from LISTED on.
NONE, UNKNOWN, FIRST = np.uint64(0), np.uint64(1), np.uint64(2)
TOP = np.uint64(1 << 63)
LISTED = 2 * FREQUENT

# Most buckets of a stored table, Spark's own bound.
MOST_BUCKETS = 100_000

# A row's number in a stored table: its task above these bits, its place there below.
PLACE_BITS = 33

OUTPUTS = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


class Lookup:
    """Places of 64-bit keys in a sorted array, found by their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.first = None

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if self.first is None:
            # Made in the task, so that it is not broadcast.
            bits = min(24, max(4, math.ceil(math.log2(len(self.keys))) + 1))
            self.down = np.uint64(64 - bits)
            cells = np.arange(1 << bits, dtype=np.uint64) << self.down
            self.first = np.searchsorted(self.keys[:-1], cells).astype(np.int32)
        at = self.first[(wanted >> self.down).astype(np.int64)].astype(np.int64)
        here = self.keys[at]
        later = np.flatnonzero(here < wanted)
        while len(later):
            at[later] += 1
            later = later[self.keys[at[later]] < wanted[later]]
        return np.where(self.keys[at] == wanted, at, -1)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of every distinct key, in the order of keys; for every key the number of its group)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(keys)]
    group = np.empty(len(keys), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


def places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in a sorted array, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers by bytes of equal weight, compressed."""
    parts = []
    for column in columns:
        used = (int(column.max()).bit_length() + 7) // 8 if len(column) else 0
        planes = np.ascontiguousarray(column, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :used]
        parts += [bytes([used]), len(column).to_bytes(8, "little"), np.ascontiguousarray(planes.T).tobytes()]
    whole = b"".join(parts)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> list[np.ndarray]:
    whole = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    columns, at = [], 0
    while at < len(whole):
        used, n = whole[at], int.from_bytes(whole[at + 1 : at + 9], "little")
        at += 9
        planes = np.zeros((n, 8), dtype=np.uint8)
        planes[:, :used] = np.frombuffer(whole, np.uint8, used * n, at).reshape(used, n).T
        columns.append(planes.reshape(-1).view("<u8"))
        at += used * n
    return columns


def _groups(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def pack_sorted(ordered: list[np.ndarray], others: list[np.ndarray]) -> bytes:
    """``pack`` of rows sorted by ``ordered``: of these, what each adds to the one before among equal beginnings."""
    steps = [ordered[0]]
    for i in range(1, len(ordered)):
        new = _groups(ordered[:i])
        step = ordered[i].copy()
        step[1:] -= np.where(new[1:], np.uint64(0), ordered[i][:-1])
        steps.append(step)
    return pack(*steps, *others)


def unpack_sorted(packed: bytes, ordered: int) -> list[np.ndarray]:
    columns = unpack(packed)
    for i in range(1, ordered):
        begins = np.flatnonzero(_groups(columns[:i]))
        total = np.cumsum(columns[i], dtype=np.uint64)
        base = total[begins] - columns[i][begins]
        columns[i] = total - np.repeat(base, np.diff(np.append(begins, len(total))))
    return columns


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of the words of every text, each text closed by an end."""
    hashes, _, _, rows = texts.words(column, texts.UNBLANK)
    n = len(rows) - 1
    out = np.empty(len(hashes) + n, dtype=np.uint64)
    own = np.ones(len(out), dtype=bool)
    own[rows[1:] + np.arange(n)] = False
    out[own] = hashes
    out[~own] = END
    return out, rows + np.arange(n + 1)


class Words:
    """Totals of the training tokens, and the counts of the frequent words by code."""

    def __init__(self, total: int, distinct: int, hashes: np.ndarray, counts: np.ndarray):
        self.mass = float(total + distinct + 1)
        by_rank = np.lexsort((hashes, -counts))
        self.counts = np.concatenate((np.zeros(int(FIRST), np.int64), counts[by_rank]))
        order = np.argsort(hashes[by_rank])
        self.lookup = Lookup(hashes[by_rank][order])
        self.codes = np.append(order + int(FIRST), int(UNKNOWN)).astype(np.uint32)

    def code(self, hashes: np.ndarray) -> np.ndarray:
        """Codes by rank; the hash with its highest bit for other words."""
        place = self.lookup.find(hashes)
        return np.where(place >= 0, self.codes[place], hashes | TOP)

    def count(self, code: np.ndarray) -> np.ndarray:
        """Counts of words with a rank, 0 for others."""
        ranked = code < LISTED
        return np.where(ranked, self.counts[np.where(ranked, code, UNKNOWN).astype(np.int64)], 0)


class Spread:
    """The bucket of every run: by the last word of its context, and for words and pairs
    with many runs by the words before it too."""

    def __init__(self, buckets: int, words: dict[int, int], pairs: dict[int, int]):
        self.buckets = buckets
        self.words, self.pairs = (
            (np.array(sorted(d), dtype=np.uint64), np.array([d[k] for k in sorted(d)], dtype=np.uint64))
            for d in (words, pairs)
        )

    @staticmethod
    def _ways(spread, keys: np.ndarray) -> np.ndarray:
        known, ways = spread
        return np.append(ways, np.uint64(1))[places(known, keys)]

    def ways(self, contexts: np.ndarray) -> np.ndarray:
        """Over how many buckets the runs of words and pairs are spread."""
        return np.maximum(self._ways(self.words, contexts), self._ways(self.pairs, contexts))

    def bucket(self, d: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
        last = texts.mix(d)
        before = texts.mix(b) % self._ways(self.words, last)
        first = texts.mix(a) % self._ways(self.pairs, texts.mix(last * BASE + b))
        return ((last % np.uint64(self.buckets)) + before + first) % np.uint64(self.buckets)

    def targets(self, d: int, b: int) -> list[int]:
        """Buckets that hold runs of a context: a word, or a pair if ``b`` is not 0."""
        d, b = np.array([d], np.uint64), np.array([b], np.uint64)
        last = texts.mix(d)
        start = int(last[0] % np.uint64(self.buckets))
        if b[0]:
            start += int((texts.mix(b) % self._ways(self.words, last))[0])
            ways = int(self._ways(self.pairs, texts.mix(last * BASE + b))[0])
        else:
            ways = int(self._ways(self.words, last)[0]) + int(self.pairs[1].max(initial=1)) - 1
        return sorted({(start + i) % self.buckets for i in range(ways)})


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in texts.slices(whole, 0)):
        found, times = np.unique(tokens(batch.column(0))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], names=["word", "n"])


def _slices(batches: Iterator[pa.RecordBatch], carry: list[str], model) -> Iterator[pa.RecordBatch]:
    """One row per slice of texts: the codes of its tokens, its words without a rank, the carried columns."""
    words: Words = model.value
    number = TaskContext.get().partitionId() << 32
    for batch in (part for whole in batches for part in texts.slices(whole, "_text")):
        hashes, rows = tokens(batch.column("_text"))
        code = words.code(hashes)
        unranked = code >= TOP
        rare, place = np.unique(hashes[unranked], return_inverse=True)
        code[unranked] = place.astype(np.uint64) + np.uint64(LISTED)
        train = np.asarray(batch.column("_train").fill_null(False).cast(pa.int64())).astype(np.uint64)
        fields = [pa.array(np.arange(batch.num_rows)), *[batch.column(c) for c in carry]]
        carried = pa.StructArray.from_arrays(fields, names=["_place", *carry])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number]), pa.array([len(code)]), pa.array([_pack_slice(code, rows.astype(np.uint64), train)]),
                pa.array([rare.view(np.int64)], pa.list_(pa.int64())),
                pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), carried),
            ],
            names=["slice", "n", "codes", "rare", "carried"],
        )
        number += 1


def _pack_slice(code: np.ndarray, rows: np.ndarray, train: np.ndarray) -> bytes:
    """Codes stay in the order of the texts, as many bytes each as the largest needs, so that
    the compression finds repeated passages."""
    width = (int(code.max(initial=0)).bit_length() + 7) // 8 or 1
    shape = pack(rows, train, np.array([width], np.uint64))
    plain = np.ascontiguousarray(code.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
    return len(shape).to_bytes(8, "little") + shape + len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _read_slice(packed: pa.Scalar, known: pa.Scalar) -> tuple[np.ndarray, ...]:
    """(codes, rows, train flags of tokens, counts of words without a rank, as they are joined)."""
    packed, known = packed.as_py(), known.values
    end = 8 + int.from_bytes(packed[:8], "little")
    rows, train, width = unpack(packed[8:end])
    size = int.from_bytes(packed[end : end + 8], "little")
    plain = pa.decompress(packed[end + 8 :], size, codec="zstd", asbytes=True)
    code = np.zeros((size // int(width[0]), 8), dtype=np.uint8)
    code[:, : int(width[0])] = np.frombuffer(plain, np.uint8).reshape(len(code), -1)
    code = code.reshape(-1).view("<i8")
    place = np.maximum(code - LISTED, -1)
    # One more, 0 and unknown, for the words that have a rank.
    counts = np.zeros(int(place.max(initial=-1)) + 2, dtype=np.int64)
    words = np.full(len(counts), UNKNOWN)
    if known is not None:
        at, word, n = (c.to_numpy(zero_copy_only=False) for c in known.flatten())
        counts[at] = n
        words[at[n >= LEAST]] = (word[n >= LEAST] + LISTED).astype(np.uint64)
    code = np.where(place >= 0, words[place], code.astype(np.uint64))
    rows = rows.astype(np.int64)
    return code, rows, np.repeat(train.astype(bool), np.diff(rows)), counts[place]


def _contexts(code: np.ndarray, rows: np.ndarray, names: np.ndarray | None = None) -> list[np.ndarray]:
    """The word before every token, the one before that, and so on: none from an unknown word on.

    ``names``: other numbers for the same words, 0 for none.
    """
    place = np.arange(len(code)) - np.repeat(rows[:-1], np.diff(rows))
    names = code if names is None else names
    found, there, known = [], np.ones(len(code), dtype=bool), code > UNKNOWN
    for n in range(1, DEPTH + 1):
        there = there & (place >= n) & np.concatenate((np.zeros(min(n, len(code)), bool), known[:-n]))
        word = np.concatenate((np.zeros(min(n, len(code)), names.dtype), names[:-n]))
        found.append(np.where(there, word, names.dtype.type(0)))
    return found


def _order(high: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """Places in the order of (high, low), both of ``2 * bits`` bits."""
    over = max(0, 4 * bits - 64)
    lead = high << np.uint64(2 * bits - over) | low >> np.uint64(over)
    order = np.argsort(lead)
    if over:
        lead = lead[order]
        same = lead[1:] == lead[:-1]
        ties = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(lead) else same
        order[ties] = order[ties][np.lexsort((low[order[ties]], lead[ties]))]
    return order


def _distinct_runs(code: np.ndarray, rows: np.ndarray, spread: Spread):
    """The distinct runs of a slice in the order of their buckets, and where each token has its own.

    Returns (tokens with a context, their runs, a token of every run, last words of the contexts
    of the runs and the words before them, buckets of the runs).
    """
    vocabulary, local = np.unique(np.append(code, NONE), return_inverse=True)
    local = local[:-1].astype(np.uint32)
    before = _contexts(code, rows, local)
    sent = np.flatnonzero(before[0])
    bits = len(vocabulary).bit_length()
    d, b, a = (c[sent].astype(np.uint64) for c in before)
    del before
    high, low = d << np.uint64(bits) | local[sent], b << np.uint64(bits) | a
    del local
    order = _order(high, low, bits)
    high, low = high[order], low[order]
    new = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))[: len(order)]
    del high, low
    begins = order[np.flatnonzero(new)]
    d, b, a = (vocabulary[c[begins].astype(np.int64)] for c in (d, b, a))
    bucket = spread.bucket(d, b, a).astype(np.int64)
    by_bucket = np.argsort(bucket, kind="stable")
    back = np.empty(len(begins), dtype=np.int64)
    back[by_bucket] = np.arange(len(begins))
    run = np.empty(len(order), dtype=np.int64)
    run[order] = back[np.cumsum(new) - 1]
    return sent, run, sent[begins[by_bucket]], [c[by_bucket] for c in (d, b, a)], bucket[by_bucket]


def _bounds(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of runs in the order of buckets."""
    found, begins = np.unique(bucket, return_index=True)
    return list(zip(found.tolist(), begins.tolist(), np.append(begins[1:], len(bucket)).tolist()))


def _pack_runs(columns: list[np.ndarray]) -> bytes:
    return pack_sorted(columns[:DEPTH + 1], columns[DEPTH + 1 :])


def _send(batches: Iterator[pa.RecordBatch], spread) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, packed, known in zip(*(batch.column(c) for c in ("slice", "codes", "known"))):
            code, rows, train, rare = _read_slice(packed, known)
            sent, run, some, (d, b, a), bucket = _distinct_runs(code, rows, spread.value)
            times = np.bincount(run, weights=train[sent], minlength=len(some)).astype(np.uint64)
            word = code[some]
            columns = [d, word, b, a, times, np.where(word == UNKNOWN, 0, rare[some]).astype(np.uint64)]
            del code, rows, train, rare, sent, run
            for at, low, high in _bounds(bucket):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at]), pa.array([number.as_py()]), pa.array([_pack_runs([c[low:high] for c in columns])])],
                    names=["bucket", "slice", "data"],
                )


def _loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, b, n): tokens after words and pairs with a fair share of a slice; decides only how runs are spread."""
    for batch in batches:
        for packed, known in zip(*(batch.column(c) for c in ("codes", "known"))):
            code, rows, _, _ = _read_slice(packed, known)
            d, b, _ = _contexts(code, rows)
            least = max(1, len(code) // (2 * MOST_HOT))
            word, times = np.unique(d[d != NONE], return_counts=True)
            word, times = word[times >= least], times[times >= least]
            near = np.flatnonzero((places(word, d) >= 0) & (b != NONE))
            first, pairs = texts.distinct(texts.mix(texts.mix(d[near]) * BASE + b[near]))
            first, pairs = near[first[pairs >= least]], pairs[pairs >= least]
            columns = np.concatenate((word, d[first])), np.concatenate((np.zeros_like(word), b[first]))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c.view(np.int64)) for c in columns], pa.array(np.concatenate((times, pairs)))],
                names=["d", "b", "n"],
            )


def _next_words(batches: Iterator[pa.RecordBatch], hot) -> Iterator[pa.RecordBatch]:
    """(context, part, next words with n and their counts if they have no rank) for the spread
    contexts of each slice, training only; a word decides its part."""
    contexts, parts = hot.value
    for batch in batches:
        for packed, known in zip(*(batch.column(c) for c in ("codes", "known"))):
            code, rows, train, rare = _read_slice(packed, known)
            d, b, _ = _contexts(code, rows)
            last = texts.mix(d)
            for context, there in ((last, d != NONE), (texts.mix(last * BASE + b), b != NONE)):
                at = np.flatnonzero(there & train)
                at = at[places(contexts, context[at]) >= 0]
                first, times = texts.distinct(texts.mix(context[at] * BASE + code[at]))
                at = at[first]
                part = texts.mix(code[at]) % parts[places(contexts, context[at])]
                order = np.lexsort((code[at], part, context[at]))
                at, part, times = at[order], part[order], times[order].astype(np.uint64)
                columns = code[at], times, rare[at].astype(np.uint64)
                begins = np.flatnonzero(_groups([context[at], part])) if len(at) else at
                data = [pack(*(c[low:high] for c in columns)) for low, high in zip(begins, np.append(begins[1:], len(at)))]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c[begins].view(np.int64)) for c in (context[at], part)], pa.array(data, pa.binary())],
                    names=["context", "part", "data"],
                )


def _pack_words(table: pa.Table) -> pa.Table:
    """The next words of a part of a spread context, from all slices, in one row."""
    word, n, rare = (np.concatenate(c) for c in zip(*(unpack(data.as_py()) for data in table.column("data"))))
    order = np.argsort(word)
    begins = np.flatnonzero(_groups([word[order]]))
    total, n = int(n.sum()), np.add.reduceat(n[order], begins)
    word, rare = word[order[begins]], rare[order[begins]]
    known = (n >= LEAST) & (word != UNKNOWN)
    data = pack(word[known], n[known], rare[known])
    return pa.table({"context": table.column("context")[:1], "total": pa.array([total]), "data": pa.array([data])})


class Level:
    """The tested contexts of one length in a bucket."""

    def __init__(self, context, word, n, shorter, hot=None):
        """Rows of runs with their counts; ``hot``: (contexts, totals, rows of runs) counted elsewhere."""
        run = texts.mix(context * BASE + word)
        first, self.of = grouped(run)
        runs, own_context = run[first], context[first]
        many = np.bincount(self.of, weights=n, minlength=len(runs))
        some, at = grouped(own_context)
        self.at, self.contexts = at, own_context[some]
        total = np.bincount(at, weights=many, minlength=len(self.contexts))
        counted = (many >= LEAST) & (word[first] != UNKNOWN)
        shorter, every = shorter[first], runs
        if hot:
            contexts, totals, (hot_context, hot_word, hot_n, hot_shorter) = hot
            place = places(self.contexts, contexts)
            there = place >= 0
            total[place[there]] = totals[there]
            elsewhere = np.zeros(len(self.contexts), dtype=bool)
            elsewhere[place[there]] = True
            counted &= ~elsewhere[at]
            place = places(self.contexts, hot_context)
            more = np.flatnonzero(place >= 0)
            hot_runs = texts.mix(hot_context[more] * BASE + hot_word[more])
            runs, at = np.concatenate((runs[counted], hot_runs)), np.concatenate((at[counted], place[more]))
            many = np.concatenate((many[counted], hot_n[more]))
            shorter = np.concatenate((shorter[counted], hot_shorter[more]))
            order = np.argsort(runs)
            runs, at, many, shorter = runs[order], at[order], many[order], shorter[order]
        else:
            runs, at, many, shorter = runs[counted], at[counted], many[counted], shorter[counted]

        def over(weights=None) -> np.ndarray:
            return np.bincount(at, weights=weights, minlength=len(self.contexts)).astype(float)

        own = (many - DISCOUNT) / total[at]
        kinds = over()
        self.total, self.twice = total, 2 * over(many) - kinds
        self.left = 1.0 - self.twice / (2 * np.maximum(total, 1.0))
        gain = over(many * np.log((own + self.left[at] * shorter) / shorter))
        gain += (total - over(many)) * np.log(np.maximum(self.left, 1e-12))
        self.kept = (kinds > 0) & (gain > DIVERGENCE * kinds)
        self.runs, self.own = runs, np.append(own, 0.0)
        # Of the runs that were given.
        many = np.append(many, 0.0)
        self.many = many[places(runs, every)]

    def given(self) -> list[np.ndarray]:
        """For every given row, where its context is kept and 0 elsewhere: count of the run, of
        the context, and twice what the next words of the context take from it."""
        at = self.at[self.of]
        kept = self.kept[at]
        return [np.where(kept, c, 0.0) for c in (self.many[self.of], self.total[at], self.twice[at])]

    def step(self, context: np.ndarray, word: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Probabilities in contexts of this length, given those in shorter ones."""
        at = places(self.contexts, context)
        some = np.flatnonzero((at >= 0) & self.kept[at]) if len(self.kept) else np.zeros(0, np.int64)
        run = places(self.runs, texts.mix(context[some] * BASE + word[some]))
        out = shorter.copy()
        out[some] = self.left[at[some]] * shorter[some] + self.own[run]
        return out


def _longer(added: np.ndarray, left: np.ndarray, n: np.ndarray, total: np.ndarray, twice: np.ndarray):
    """What contexts add to a probability, and what they leave of the word's own, with those of one more length."""
    some = np.maximum(total, 1.0)
    leaves = 1.0 - twice / (2 * some)
    return leaves * added + np.where(n > 0, (n - DISCOUNT) / some, 0.0), leaves * left


def _root(words: Words, word: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Probabilities of single words; 1 for unknown ones, which no context adds to."""
    return np.where(word == UNKNOWN, 1.0, (words.count(word) + rare.astype(np.int64) + 1.0) / words.mass)


def _hot_rows(rows: list[dict], level: int, words: Words, shorter: Level | None):
    """What ``Level`` wants to know of the spread contexts of a length."""
    rows = [r for r in rows if bool(r["b"]) == (level == 1)]
    if not rows:
        return None
    totals: dict[int, int] = {}
    parts = []
    for r in rows:
        context = np.array([r["context"]], np.int64).view(np.uint64)
        totals[int(context[0])] = totals.get(int(context[0]), 0) + r["total"]
        word, n, rare = unpack(r["data"])
        p = _root(words, word, rare)
        if shorter:
            p = shorter.step(np.repeat(texts.mix(np.array([r["d"]], np.int64).view(np.uint64)), len(word)), word, p)
        parts.append((np.repeat(context, len(word)), word, n.astype(float), p))
    contexts = np.array(sorted(totals), dtype=np.uint64)
    return contexts, np.array([totals[int(c)] for c in contexts], float), [np.concatenate(c) for c in zip(*parts)]


def _judge(table: pa.Table, model) -> pa.Table:
    """For every run in a bucket, to the slices that sent it: the counts of its retained contexts."""
    words: Words = model.value
    rows = table.to_pylist()
    hot = sorted((r for r in rows if r["slice"] is None), key=lambda r: (r["context"], r["data"]))
    rows = [r for r in rows if r["slice"] is not None]
    if not rows:
        return pa.table({"slice": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
    columns = [[] for _ in range(DEPTH + 3)]
    for r in rows:
        for column, part in zip(columns, unpack_sorted(r.pop("data"), DEPTH + 1)):
            column.append(part)
    ends = np.cumsum([len(part) for part in columns[0]])
    for i, parts in enumerate(columns):
        columns[i] = np.concatenate(parts)
        parts.clear()
    d, word, b, a, n, rare = columns
    # The probability of a run is what its contexts add and what they leave of that of its word.
    root, context, level = _root(words, word, rare), None, None
    added, left, found, before = np.zeros(len(root)), np.ones(len(root)), [], [a, b, d]
    del columns, parts, rare, d, b, a
    for size in range(DEPTH):
        older = before.pop()
        at = np.flatnonzero(older != NONE)
        context = texts.mix(older) if context is None else texts.mix(context * BASE + older)
        elsewhere = _hot_rows(hot, size, words, level) if size < 2 else None
        p = added[at] + left[at] * root[at]
        level = Level(context[at], word[at], n[at].astype(float), p, elsewhere)
        counts = level.given()
        added[at], left[at] = _longer(added[at], left[at], *counts)
        for column in counts:
            whole = np.zeros(len(root), dtype=np.min_scalar_type(int(column.max(initial=0))))
            whole[at] = column
            found.append(whole)
    data = [pack(*part) for part in zip(*[np.split(c, ends[:-1]) for c in found])]
    return pa.table({
        "slice": pa.array([r["slice"] for r in rows]), "bucket": pa.array([r["bucket"] for r in rows]),
        "data": pa.array(data, pa.binary()),
    })


def _finish(slices: pa.Table, judged: pa.Table, carry: list[str], total: int, model, spread) -> pa.Table:
    """The rows of a slice with their scores."""
    words: Words = model.value
    code, rows, _, rare = _read_slice(slices.column("codes")[0], slices.column("known")[0])
    count = words.count(code) + rare
    root = (count + 1.0) / words.mass
    p = root.copy()
    sent, run, _, _, bucket = _distinct_runs(code, rows, spread.value)
    del code, rare
    found = dict(zip(judged.column("bucket").to_pylist(), judged.column("data")))
    added, left = np.zeros(len(bucket)), np.ones(len(bucket))
    for at, low, high in _bounds(bucket):
        counts = [c.astype(float) for c in unpack(found.pop(at).as_py())]
        for i in range(0, len(counts), 3):
            added[low:high], left[low:high] = _longer(added[low:high], left[low:high], *counts[i : i + 3])
    p[sent] = added[run] + left[run] * root[sent]

    def per_row(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, rows[:-1])

    carried = slices.column("carried")[0].values
    columns = dict(zip(["_place", *carry], carried.flatten()))
    columns = {c: columns[c] for c in carry}
    return pa.table({
        **columns, "n_tokens": np.diff(rows), "n_known": per_row((count > 0).astype(np.int64)),
        "train_tokens": np.full(len(rows) - 1, total), "base_score": per_row(np.log10(root)), "score": per_row(np.log10(p)),
    })


def _spread(slices: DataFrame, every: int) -> tuple[Spread, dict[int, tuple[int, int]]]:
    """How the runs of ``every`` tokens are spread, and the spread contexts with their words."""
    size = max(TASK, every // MOST_HOT)
    loads = slices.mapInArrow(_loads, "d bigint, b bigint, n bigint").groupBy("d", "b").agg(F.sum("n").alias("n"))
    words, pairs, contexts = {}, {}, {}
    for r in loads.where(F.col("n") > size).collect():
        d, b = (np.array([x], np.int64).view(np.uint64) for x in (r.d, r.b))
        key = texts.mix(d) if not r.b else texts.mix(texts.mix(d) * BASE + b)
        (pairs if r.b else words)[int(key[0])] = -(-r.n // size)
        contexts[int(key[0])] = (int(d[0]), int(b[0]))
    return Spread(max(1, -(-every // size)), words, pairs), contexts


@shielded("text", "train", outputs=OUTPUTS)
def score(df: DataFrame, train: str | None = None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Learn the tree from the texts of rows where ``train`` is true (None: all) and score all rows with it.

    Returns the ``carry`` columns (all by default) with ``n_tokens`` (words and one
    end), ``n_known`` (tokens seen in training), ``train_tokens``, ``base_score``
    (log10 probability by single words, one added to every count) and ``score`` (by the tree).
    Words are what stands between blanks, A-Z folded. A null text counts as empty, one end; a
    null ``train`` as false. Without training tokens every score is 0. Equal texts score
    equally. An empty table gives no rows. Columns of any name are carried; those of the outputs'
    names are replaced.

    Counts of words and the coded texts with the carried columns are stored once in the shared
    checkpoint folder, the latter as a table in buckets by slice, so that no later step moves
    them. Memory of a task is bounded by its slice or its bucket; the next words of a
    spread context, of which every bucket needs all, by the words of the language.
    """
    spark = df.sparkSession
    own = F.col(train).cast("boolean") if train else F.lit(True)
    rows = df.select(*[F.col(f"`{c}`") for c in carry], F.col(text).alias("_text"), own.alias("_train"))
    counts = store(
        rows.where("_train").select("_text").mapInArrow(_word_counts, "word bigint, n bigint")
        .groupBy("word").agg(F.sum("n").alias("n")).withColumn("id", F.monotonically_increasing_id())
    )
    # By powers of two: how many words are that frequent.
    task = F.shiftright("id", PLACE_BITS)
    powers = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(
        F.count("*").alias("v"), F.sum("n").alias("n"), (F.max(task) + 1).alias("tasks")
    )
    powers = {r.power: r for r in powers.collect()}
    # Numbers of words without gaps between tasks, as far as these have equally many.
    tasks = max((r.tasks for r in powers.values()), default=1)
    counts = counts.withColumn("id", F.col("id").bitwiseAND((1 << PLACE_BITS) - 1) * tasks + task)
    total, distinct = sum(r.n for r in powers.values()), sum(r.v for r in powers.values())
    least = 1
    while sum(r.v for p, r in powers.items() if p >= least) > FREQUENT:
        least += 1
    frequent = counts.where(F.col("n") >= 1 << least).select("word", "n").toArrow()
    frequent = [frequent.column(c).combine_chunks().to_numpy() for c in ("word", "n")]
    model = spark.sparkContext.broadcast(Words(total, distinct, frequent[0].view(np.uint64), frequent[1]))
    del frequent

    carried = T.StructType([T.StructField("_place", T.LongType()), *[rows.schema[c] for c in carry]])
    schema = T.StructType.fromDDL("slice bigint, n bigint, codes binary, rare array<bigint>").add("carried", T.ArrayType(carried))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("bytes")).first().bytes
    many = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // texts.SLICE)), MOST_BUCKETS)
    slices = store_by(rows.mapInArrow(partial(_slices, carry=carry, model=model), schema), "slice", many)
    rare = slices.select("slice", F.posexplode("rare").alias("pos", "word")).join(counts.where(F.col("n") < 1 << least), "word")
    known = rare.groupBy("slice").agg(F.collect_list(F.struct("pos", F.col("id").alias("word"), "n")).alias("known"))
    known = store_by(known, "slice", many)
    # Only words without a rank that training has twice can be part of a context.
    coded = slices.select("slice", "codes")
    if least > 1:
        coded = coded.join(known, "slice", "left")
    else:
        coded = coded.withColumn("known", F.lit(None).cast(known.schema["known"].dataType))

    every = slices.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    spread, contexts = _spread(coded, every)
    ways = spark.sparkContext.broadcast(spread)
    sent = coded.mapInArrow(partial(_send, spread=ways), "bucket bigint, slice bigint, data binary")
    more = {c: F.lit(None).cast("bigint").alias(c) for c in ("context", "total", "d", "b")}
    sent = sent.select("bucket", "slice", *more.values(), "data")
    if contexts:
        keys = np.array(sorted(contexts), dtype=np.uint64)
        hot = spark.sparkContext.broadcast((keys, np.maximum(spread.ways(keys), np.uint64(PARTS))))
        signed = lambda x: int(np.uint64(x).astype(np.int64))
        targets = literal_table(
            spark, pa.schema([(c, pa.int64()) for c in ("context", "d", "b", "bucket")]),
            [(signed(key), signed(d), signed(b), at) for key, (d, b) in contexts.items() for at in spread.targets(d, b)],
        )
        nexts = (
            coded.mapInArrow(partial(_next_words, hot=hot), "context bigint, part bigint, data binary")
            .groupBy("context", "part").applyInArrow(_pack_words, "context bigint, total bigint, data binary")
        )
        none = F.lit(None).cast("bigint").alias("slice")
        sent = sent.unionByName(nexts.join(targets, "context").select("bucket", none, "context", "total", "d", "b", "data"))
    judged = sent.repartition(spread.buckets, "bucket").groupBy("bucket").applyInArrow(
        lambda group: _judge(group, model), "slice bigint, bucket bigint, data binary"
    )
    out = T.StructType([
        *[rows.schema[c] for c in carry],
        *T.StructType.fromDDL("n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").fields,
    ])
    whole = slices.join(known, "slice", "left").select("slice", "codes", "known", "carried")
    return whole.groupBy("slice").cogroup(judged.groupBy("slice")).applyInArrow(
        lambda left, right: _finish(left, right, carry, total, model, ways), out
    )
