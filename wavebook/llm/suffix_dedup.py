"""Removal of long repeated passages with suffix sorting.

A string of 400 bytes is repeated if it starts anywhere else in the corpus, too.
Every such string contains the smallest of its hashed runs of 200 bytes, its core;
equal strings have equal cores at the same place. So only the surroundings of cores
that occur again meet, grouped by the core: their continuations are cut into
symbols and put in suffix order by linear grouping (``suffix_order``), the common
prefixes of neighbours give which strings agree to the right of the core, and
hashes of what precedes it which agree to the left.

A core with very many surroundings is not brought to one task: its 400-byte strings
are compared by hashes, dealt out by the hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from wavebook.llm import texts
from wavebook.llm.common import fresh, materialise, shielded
from wavebook.llm.suffix_order import suffix_order

LENGTH = 400
CORE = LENGTH // 2
REACH = LENGTH - CORE
SYMBOL = 40

# Positions of the filter of cores that occur again; 16 MB of bits at most.
FILTER_WORDS = 1 << 21

# A core is spread out above this number of places and this share of all of them.
SPREAD_COUNT = 4000
SPREAD_SHARE = 1e-7

# Hashes of spread-out strings compared in one task; bytes of surroundings sorted together.
BUCKET_STRINGS = 1 << 19
SORTED_BYTES = 2 << 20

PIECE = 1 << 20
PLACE_MASK = np.uint64((1 << 22) - 1)

OUTPUTS = {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
FOUND = (
    "kind int, core bigint, bucket bigint, key binary, lead int, places array<int>, around binary, "
    "strings array<bigint>, owners array<int>, owner_keys array<int>, keys array<binary>"
)
SURROUNDING, STRINGS, REPEATED = 0, 1, 2

_inverse = pow(texts.BASE, -1, 1 << 64)


def _inverse_powers(n: int, _cache: list = [np.ones(1, dtype=np.uint64)]) -> np.ndarray:
    if len(_cache[0]) < n:
        steps = np.full(max(n, 1024), _inverse, dtype=np.uint64)
        steps[0] = 1
        _cache[0] = np.multiply.accumulate(steps)
    return _cache[0][:n]


class Hashes:
    """Hashes of any substrings of some bytes, from one pass over them."""

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(texts.BYTE_VALUES[data] * texts.powers(len(data)), out=self.total[1:])
        self.back = _inverse_powers(len(data) + 1)

    def of(self, starts: np.ndarray, size: int) -> np.ndarray:
        return texts.mix((self.total[starts + size] - self.total[starts]) * self.back[starts])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def stretches(offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first byte, bytes' end, starts, ends): texts of at least 400 bytes in pieces.

    A text longer than a piece is cut into pieces that share 399 bytes, so that
    every string of 400 bytes lies in one of them.
    """
    starts, ends = offsets[:-1], offsets[1:]
    long = ends - starts >= LENGTH
    cut_starts, cut_ends = [], []
    for s, e in zip(starts[long], ends[long]):
        at = np.arange(s, max(e - LENGTH + 1, s + 1), PIECE)
        cut_starts.append(at)
        cut_ends.append(np.minimum(at + PIECE + LENGTH - 1, e))
    if not cut_starts:
        return
    starts, ends = np.concatenate(cut_starts), np.concatenate(cut_ends)
    at = 0
    while at < len(starts):
        last = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, side="right")))
        yield int(starts[at]), int(ends[last - 1]), starts[at:last], ends[at:last]
        at = last


class Piece(NamedTuple):
    """Bytes ``low`` to ``high`` with their hashes and, per start, the core of its string."""

    low: int
    high: int
    hashes: Hashes
    least: np.ndarray

    def core_of(self, starts: np.ndarray) -> np.ndarray:
        return (self.least[starts - self.low] & PLACE_MASK).astype(np.int64) + self.low


def cores(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, "Piece"]]:
    """(hashes, places, piece): the cores of every piece."""
    for low, high, starts, ends in stretches(offsets):
        piece = Hashes(data[low:high])
        runs = piece.of(np.arange(high - low - CORE + 1), CORE)
        packed = (runs & ~PLACE_MASK) | np.arange(len(runs), dtype=np.uint64)
        least = _least(packed, REACH + 1)
        inside = np.zeros(len(least) + 1, dtype=np.int32)
        np.add.at(inside, starts - low, 1)
        np.add.at(inside, np.minimum(ends - low - LENGTH + 1, len(least)), -1)
        chosen = least[np.cumsum(inside[:-1]) > 0]
        places = np.unique((chosen[np.append(True, chosen[1:] != chosen[:-1])] & PLACE_MASK).astype(np.int64)) if len(chosen) else np.zeros(0, np.int64)
        yield runs[places], places + low, Piece(low, high, piece, least)


def _new_places(places: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Which cores of a piece the piece before, given by its places, does not have: those
    in the bytes that both share are the same occurrence."""
    return ~np.isin(places, before)


def _count_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in texts.slices(whole, 0)):
        before = np.zeros(0, dtype=np.int64)
        for runs, places, _ in cores(*texts.raw(batch.column(0))):
            found, times = np.unique(runs[_new_places(places, before)], return_counts=True)
            before = places
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], names=["core", "n"])


def _listed(filter_words: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Whether cores may be in the filter: two bits of a word."""
    word = filter_words[(runs % np.uint64(FILTER_WORDS)).astype(np.int64)]
    bits = _bits(runs)
    return (word & bits) == bits


def _bits(runs: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    return (one << (runs >> np.uint64(58))) | (one << ((runs >> np.uint64(52)) & np.uint64(63)))


def repeated_cores(df: DataFrame, text: str) -> tuple[np.ndarray, dict[int, int]]:
    """A filter of the cores that occur again, and the counts of those to be spread out.

    The filter has a fixed size; cores above a share of all places are bounded in
    number by that share. Cores that only seem to occur again meet nobody later.
    """
    counts = materialise(
        df.select(F.col(text).alias("text")).mapInArrow(_count_cores, "core bigint, n bigint")
        .groupBy("core").agg(F.sum("n").alias("n")).where("n > 1")
    )
    unsigned = F.pmod(F.col("core"), F.lit(FILTER_WORDS))  # the same for signed: a power of two
    one = F.lit(1).cast("bigint")
    bit = [
        F.call_function("shiftleft", one, F.shiftrightunsigned("core", 58).cast("int")),
        F.call_function("shiftleft", one, F.shiftrightunsigned("core", 52).bitwiseAND(F.lit(63)).cast("int")),
    ]
    words = (
        counts.groupBy(unsigned.alias("word")).agg(F.bit_or(bit[0].bitwiseOR(bit[1])).alias("bits")).toPandas()
    )
    table = np.zeros(FILTER_WORDS, dtype=np.uint64)
    table[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    places = counts.agg(F.sum("n")).first()[0] or 0
    many = counts.where((F.col("n") > SPREAD_COUNT) & (F.col("n") > places * SPREAD_SHARE)).toPandas()
    return table, dict(zip(many["core"].tolist(), many["n"].tolist()))


def _surroundings(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """What every text sends to the groups of its cores.

    Of the copies of a text in one task two are enough: more add no other string,
    and spans belong to texts, not rows.
    """
    table, spread = model.value
    spread_cores = np.array(sorted(spread), dtype=np.int64).view(np.uint64)
    seen: dict[bytes, int] = {}
    for batch in (part for whole in batches for part in texts.slices(whole, 0)):
        keys = batch.column(1).to_pylist()
        wanted = []
        for key in keys:
            seen[key] = seen.get(key, 0) + 1
            wanted.append(seen[key] <= 2)
        data, offsets = texts.raw(batch.column(0))
        wanted = np.array(wanted, dtype=bool)
        before = np.zeros(0, dtype=np.int64)
        for runs, places, piece in cores(data, offsets):
            row = np.searchsorted(offsets, places, side="right") - 1
            use = _listed(table, runs) & wanted[row]
            wide = np.isin(runs, spread_cores)
            # Surroundings are whole in any piece, so each goes once; strings are those of the piece.
            once = use & ~wide & _new_places(places, before)
            before = places
            yield from _single(data, offsets, keys, runs[once], places[once], row[once])
            if (use & wide).any():
                yield from _strings(offsets, keys, spread, runs[use & wide], places[use & wide], row[use & wide], piece)


def _record(kind: int, n: int, **columns) -> pa.RecordBatch:
    types = {
        "kind": pa.int32(), "core": pa.int64(), "bucket": pa.int64(), "key": pa.binary(), "lead": pa.int32(),
        "places": pa.list_(pa.int32()), "around": pa.binary(), "strings": pa.list_(pa.int64()),
        "owners": pa.list_(pa.int32()), "owner_keys": pa.list_(pa.int32()), "keys": pa.list_(pa.binary()),
    }
    columns["kind"] = np.full(n, kind, dtype=np.int32)
    arrays = [pa.nulls(n, t) if k not in columns else pa.array(columns[k], t) for k, t in types.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(types))


def _single(data, offsets, keys, runs, places, row) -> Iterator[pa.RecordBatch]:
    """Surroundings of cores, equal ones of a text once with all their places."""
    if not len(places):
        return
    starts = np.maximum(offsets[row], places - REACH)
    ends = np.minimum(offsets[row + 1], places + LENGTH)
    merged: dict[tuple, list[int]] = {}
    for core, r, s, p, e in zip(runs.view(np.int64).tolist(), row.tolist(), starts.tolist(), places.tolist(), ends.tolist()):
        merged.setdefault((core, r, p - s, data[s:e].tobytes()), []).append(p - int(offsets[r]))
    yield _record(
        SURROUNDING, len(merged), core=[k[0] for k in merged], bucket=[0] * len(merged),
        key=[keys[k[1]] for k in merged], lead=[k[2] for k in merged], places=list(merged.values()),
        around=[k[3] for k in merged],
    )


def _strings(offsets, keys, spread, runs, places, row, piece: Piece) -> Iterator[pa.RecordBatch]:
    """Hashes of the 400-byte strings that have a spread-out core, by core and bucket.

    Every string goes with its own core only, so none meets itself. Strings that a piece has twice are repeated already; one of them goes on, to
    tell strings of other pieces.
    """
    start = places[:, None] - np.arange(REACH + 1)[None, :]
    inside = (start >= np.maximum(offsets[row], piece.low)[:, None]) & (
        start + LENGTH <= np.minimum(offsets[row + 1], piece.high)[:, None]
    )
    which, back = np.nonzero(inside)
    start = start[which, back]
    own = piece.core_of(start) == places[which]
    which, start = which[own], start[own]
    if not len(start):
        return
    strings = piece.hashes.of(start - piece.low, LENGTH)
    own_row, core = row[which], runs[which]
    place = start - offsets[own_row]
    twice = texts.repeated(strings)
    first, _ = texts.distinct(strings)
    if twice.any():
        yield from _spans(keys, own_row[twice], place[twice])
    # -1 as the place says that the string is known to be repeated.
    owner = np.where(twice, -1, place).astype(np.int32)[first]
    strings, own_row, core = strings[first], own_row[first], core[first]
    signed = core.view(np.int64)
    buckets = np.array([1 + spread[c] * (REACH + 1) // BUCKET_STRINGS for c in signed.tolist()], dtype=np.uint64)
    bucket = (strings % buckets).astype(np.int64)
    order = np.lexsort((bucket, signed))
    change = np.flatnonzero((np.diff(signed[order]) != 0) | (np.diff(bucket[order]) != 0)) + 1
    groups = np.split(order, change)
    named = [np.unique(own_row[g], return_inverse=True) for g in groups]
    yield _record(
        STRINGS, len(groups), core=[int(signed[g[0]]) for g in groups], bucket=[int(bucket[g[0]]) for g in groups],
        strings=[strings[g].view(np.int64) for g in groups], owners=[owner[g] for g in groups],
        owner_keys=[which.astype(np.int32) for _, which in named],
        keys=[[keys[r] for r in rows.tolist()] for rows, _ in named],
    )


def _spans(keys: list[bytes], row: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of starts of repeated strings, as (first, last) pairs per text."""
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] > place[:-1] + 1)
    begins = np.flatnonzero(new)
    lasts = np.append(begins[1:], len(row)) - 1
    found: dict[int, list[int]] = {}
    for r, a, b in zip(row[begins].tolist(), place[begins].tolist(), place[lasts].tolist()):
        found.setdefault(r, []).extend((a, b))
    yield _record(REPEATED, len(found), core=[r % 1024 for r in found], bucket=[0] * len(found), key=[keys[r] for r in found], places=list(found.values()))


def repeated_starts(core: np.ndarray, lead: np.ndarray, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For surroundings of cores: which of the strings 0 to REACH bytes before the core are
    in another surrounding of the same core, too. A row per surrounding, whose bytes are
    ``flat[begin[i] : begin[i + 1]]``, the core ``lead[i]`` bytes in."""
    n = len(core)
    right = np.diff(begin) - lead - CORE
    begin = begin[:-1]
    steps = -(-REACH // SYMBOL)
    columns = np.arange(steps * SYMBOL)
    at = np.minimum(begin[:, None] + lead[:, None] + CORE + columns[None, :], len(flat) - 1)
    after = np.where(columns[None, :] < right[:, None], flat[at], np.uint8(0))
    symbols = np.ascontiguousarray(after).view(f"S{SYMBOL}").ravel()
    rank = np.unique(symbols, return_inverse=True)[1].reshape(n, steps)
    group = np.unique(core, return_inverse=True)[1]
    # 0 ends the text and 1 every row; then come the groups, then the symbols.
    text = np.ones((n, steps + 2), dtype=np.int64)
    text[:, 0] = group + 2
    text[:, 1:-1] = rank + 2 + int(group.max()) + 1
    order = np.array(suffix_order([*text.ravel().tolist(), 0]), dtype=np.int64)
    rows = order[(order % (steps + 2) == 0) & (order < n * (steps + 2))] // (steps + 2)
    # Common bytes after the core of neighbours in the order.
    differ = after[rows[1:]] != after[rows[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), steps * SYMBOL)
    common = np.minimum(common, np.minimum(right[rows[1:]], right[rows[:-1]]))
    common[group[rows[1:]] != group[rows[:-1]]] = -1
    # Hashes of the bytes before the core, for every length.
    back = np.arange(1, REACH + 1)
    at = np.maximum(begin[:, None] + lead[:, None] - back[None, :], 0)
    before = np.where(back[None, :] <= lead[:, None], texts.BYTE_VALUES[flat[at]], np.uint64(0))
    left = np.zeros((n, REACH + 1), dtype=np.uint64)
    np.cumsum(before * texts.powers(REACH)[None, :], axis=1, out=left[:, 1:])
    found = np.zeros((n, REACH + 1), dtype=bool)
    for a in range(REACH + 1):
        need = REACH - a
        valid = (lead[rows] >= a) & (right[rows] >= need)
        interval = np.concatenate(([0], np.cumsum(common < need))).astype(np.uint64)
        key = texts.mix(left[rows, a] + interval * np.uint64(texts.BASE))[valid]
        found[rows[valid], a] = texts.repeated(key)
    return found


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, pairs): runs of starts of repeated strings, from what has come together.

    Rows come sorted by kind and group. The last group of a batch may go on in the
    next one, so it waits; many small groups are taken together.
    """
    waiting: pa.Table | None = None
    for batch in (part for whole in batches for part in _cut(whole)):
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([waiting, table]).combine_chunks() if waiting is not None else table
        begins = _group_begins(table)
        waiting = table.slice(begins[-1])
        if len(begins) > 1:
            yield from _groups(table.slice(0, begins[-1]), begins[:-1])
    if waiting is not None and waiting.num_rows:
        yield from _groups(waiting, np.zeros(1, dtype=np.int64))


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded size: rows with strings are large."""
    rows = max(1, min(batch.num_rows, int(batch.num_rows * SORTED_BYTES / max(batch.nbytes, 1))))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _group_begins(table: pa.Table) -> np.ndarray:
    columns = [table.column(n).to_numpy() for n in ("kind", "core", "bucket")]
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _groups(table: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What whole groups give: each kind in its own way, strings group by group."""
    kinds = table.column("kind").to_numpy()
    for kind in np.unique(kinds):
        low, high = np.searchsorted(kinds, (kind, kind + 1))
        if kind == REPEATED:
            part = table.slice(low, high - low).combine_chunks()
            yield _starts(part.column("key").combine_chunks(), part.column("places").combine_chunks())
        elif kind == SURROUNDING:
            yield from _surrounded(table.slice(low, high - low))
        else:
            own = begins[(begins >= low) & (begins < high)]
            for first, last in zip(own, np.append(own[1:], high)):
                yield from _same_strings(table.slice(first, last - first))


def _starts(keys: pa.Array, pairs: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys, pairs], names=["key", "pairs"])


def _listed_pairs(keys: pa.Array, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """(key, flat pairs) per row that has some; ``row`` must be sorted."""
    own = np.unique(row)
    offsets = np.append(np.searchsorted(row, own), len(row)) * 2
    flat = np.stack([first, last], axis=1).ravel()
    pairs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
    return _starts(keys.take(pa.array(own)), pairs)


def _same_strings(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Strings of one bucket that several texts, or a text several times, have."""
    part = {n: table.column(n).combine_chunks() for n in ("strings", "owners", "owner_keys", "keys")}
    sizes = pa.compute.list_value_length(part["strings"]).to_numpy()
    named = pa.compute.list_value_length(part["keys"]).to_numpy()
    strings, owners = part["strings"].flatten().to_numpy(), part["owners"].flatten().to_numpy()
    key = part["owner_keys"].flatten().to_numpy() + np.repeat(np.cumsum(named) - named, sizes)
    hit = np.flatnonzero(texts.repeated(strings) & (owners >= 0))
    if len(hit):
        hit = hit[np.lexsort((owners[hit], key[hit]))]
        row, at = key[hit], owners[hit]
        new = np.append(True, (row[1:] != row[:-1]) | (at[1:] > at[:-1] + 1))
        begins = np.flatnonzero(new)
        last = at[np.append(begins[1:], len(at)) - 1]
        yield _listed_pairs(part["keys"].flatten(), row[begins], at[begins], last)


def _surrounded(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Strings around cores that are repeated, found by suffix order within groups."""
    core = table.column("core").to_numpy()
    places = table.column("places").combine_chunks()
    times = pa.compute.list_value_length(places).to_numpy()
    # Cores that nothing else has, by chance in the filter, have nobody to meet.
    some = np.flatnonzero(texts.repeated(core) | (times > 1))
    if not len(some):
        return
    table = table.take(pa.array(some)).combine_chunks()
    core, times = core[some], times[some].astype(np.int64)
    lead = table.column("lead").to_numpy().astype(np.int64)
    keys, around = table.column("key").combine_chunks(), table.column("around").combine_chunks()
    at = table.column("places").combine_chunks().flatten().to_numpy().astype(np.int64)
    flat, begin = texts.raw(around)
    found = np.empty((len(some), REACH + 1), dtype=bool)
    # Whole groups together, up to a size.
    change = np.append(np.flatnonzero(np.append(True, core[1:] != core[:-1])), len(core))
    first = 0
    while first < len(core):
        over = np.searchsorted(begin[change], begin[first] + SORTED_BYTES)
        last = int(change[min(max(over, np.searchsorted(change, first) + 1), len(change) - 1)])
        bounds = begin[first : last + 1]
        found[first:last] = repeated_starts(core[first:last], lead[first:last], flat[bounds[0] : bounds[-1]], bounds - bounds[0])
        first = last
    # A text with several places for equal surroundings repeats all strings in them.
    right = np.diff(begin) - lead - CORE
    back = np.arange(REACH + 1)
    inside = (back[None, :] <= lead[:, None]) & (REACH - back[None, :] <= right[:, None])
    found = np.where((times > 1)[:, None], inside, found)
    edge = np.zeros((len(found), 1), dtype=bool)
    starts_at = np.nonzero(found & ~np.hstack([edge, found[:, :-1]]))
    ends_at = np.nonzero(found & ~np.hstack([found[:, 1:], edge]))
    row = starts_at[0]
    # Every run of distances before the core, at each place of the surrounding.
    repeat = times[row]
    place_begin = np.cumsum(times) - times
    nth = np.arange(int(repeat.sum())) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    place = at[np.repeat(place_begin[row], repeat) + nth]
    low, high = place - np.repeat(ends_at[1], repeat), place - np.repeat(starts_at[1], repeat)
    if len(row):
        yield _listed_pairs(keys, np.repeat(row, repeat), low, high)


def _remove(batch: pa.RecordBatch, text: str, spans: str) -> dict[str, pa.Array]:
    data, offsets = texts.raw(batch.column(batch.schema.get_field_index(text)))
    listed = batch.column(batch.schema.get_field_index(spans))
    counts = pa.compute.fill_null(pa.compute.list_value_length(listed), 0).to_numpy()
    runs = listed.flatten()
    inner = pa.compute.list_value_length(runs).to_numpy() // 2
    ends = runs.flatten().to_numpy().reshape(-1, 2)
    start = offsets[np.repeat(np.repeat(np.arange(batch.num_rows), counts), inner)]
    edges = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(edges, start + ends[:, 0], 1)
    np.add.at(edges, start + ends[:, 1] + LENGTH, -1)
    gone = np.cumsum(edges[:-1]) > 0
    removed = texts.sums(gone.astype(np.int64), offsets)
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = gone[first]
    kept = [
        hashlib.sha256((data[a:b][~gone[a:b]] if n else data[a:b]).tobytes()).hexdigest()
        for a, b, n in zip(offsets.tolist(), offsets[1:].tolist(), removed.tolist())
    ]
    return {
        "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed),
        "n_spans": pa.array(texts.sums(begins.astype(np.int64), offsets)), "kept_sha256": pa.array(kept, pa.string()),
    }


def repeated_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """(key, spans) of texts with repeated strings: the key is the first half of the text's
    SHA-256, a span the flat (first, last) starts of strings; stored."""
    whole = F.coalesce(F.col(text), F.lit(""))
    model = df.sparkSession.sparkContext.broadcast(repeated_cores(df, text))
    keyed = df.select(whole.alias("text"), text_key(whole).alias("key"))
    sent = keyed.mapInArrow(partial(_surroundings, model=model), FOUND)
    met = (
        sent.repartition("kind", "core", "bucket").sortWithinPartitions("kind", "core", "bucket")
        .mapInArrow(_meet, "key binary, pairs array<int>")
    )
    return materialise(met.groupBy("key").agg(F.collect_list("pairs").alias("spans")))


def text_key(text):
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


@shielded("text", outputs=list(OUTPUTS))
def suffix_dedup(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Say what of every text stays without the bytes of repeated 400-byte strings.

    Returns the ``carry`` columns (all by default) with ``n_bytes`` (UTF-8),
    ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept_sha256`` of the
    bytes that stay. Strings are judged on the input, every occurrence goes,
    overlaps count, and none goes across texts. A null text counts as empty; texts
    below 400 bytes lose nothing. Equal texts have equal results. An empty table
    gives no rows. Columns of any name are carried; those of the outputs' names are replaced.
    """
    own, key, spans = fresh(df, "_text", "_key", "_spans")
    found = repeated_spans(df, text).withColumnsRenamed({"key": "_found", "spans": spans})
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(*[F.col(f"`{c}`") for c in carry], whole.alias(own), text_key(whole).alias(key))
    joined = rows.join(found, F.col(key) == F.col("_found"), "left").drop("_found", key)
    return texts.map_batches(joined, OUTPUTS, partial(_remove, text=own, spans=spans), own, drop=(own, spans))
