"""Arrow text columns as numpy arrays of word hashes.

A word is a maximal run of bytes of a class; its 64-bit hash is the sum of random
values of its bytes times powers of an odd number, then mixed. All work is on whole
arrays, a few megabytes of text at a time, so memory stays bounded however long a
text is: what is kept is eight bytes per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

PIECE = 1 << 20

# Bytes of text for a slice.
SLICE = 8 * PIECE

_random = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLDED_VALUES = BYTE_VALUES[FOLD]
BASE = 0x9E3779B97F4A7C15

# Words of letters, digits and bytes beyond ASCII; and words between blanks.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
UNBLANK = np.ones(256, dtype=bool)
UNBLANK[[32, *range(9, 14)]] = False


def powers(n: int, _cache: list = [np.ones(1, dtype=np.uint64)]) -> np.ndarray:
    """BASE ** 0 .. BASE ** (n - 1) modulo 2 ** 64."""
    if len(_cache[0]) < n:
        steps = np.full(max(n, 1024), BASE, dtype=np.uint64)
        steps[0] = 1
        _cache[0] = np.multiply.accumulate(steps)
    return _cache[0][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]] if len(column) else data[:0], at - at[0]


def _piece(data: np.ndarray, breaks: np.ndarray, inside: np.ndarray, values: np.ndarray):
    """Hashes, starts and ends of the words of some bytes; no word goes across a break."""
    word = inside[data]
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    before[breaks] = False
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[breaks[breaks > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    hashes = np.add.reduceat(values[data[word]] * powers(int(sizes.max()))[place], first)
    return mix(hashes), starts, ends


def words(column: pa.Array, inside: np.ndarray = LETTERS, fold: bool = True):
    """(hashes, starts, ends, rows): the words of a column and, per row, where they begin.

    ``starts`` and ``ends`` are bytes of the column's data; the words of row ``i``
    are ``rows[i]`` to ``rows[i + 1]``.
    """
    return words_of(*raw(column), inside, FOLDED_VALUES if fold else BYTE_VALUES)


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, values: np.ndarray):
    """``words`` of bytes and row offsets."""
    parts, at = [], 0
    while at < len(data):
        end, since = min(at + PIECE, len(data)), at
        while end < len(data) and inside[data[end]] and inside[data[end - 1]]:
            # Not inside a word: back to its begin, or on to its end if it began before.
            gap = np.flatnonzero(~inside[data[since:end]])
            if len(gap):
                end = since + int(gap[-1]) + 1
                break
            end, since = min(end + PIECE, len(data)), end
        low, high = np.searchsorted(offsets, (at, end))
        breaks = np.unique(offsets[low:high] - at)
        hashes, starts, ends = _piece(data[at:end], breaks, inside, values)
        parts.append((hashes, starts + at, ends + at))
        at = end
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), dtype=np.int64)
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of runs of ``size`` words; a shorter row that has words is one run."""
    counts = np.diff(rows)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_rows = np.concatenate(([0], np.cumsum(runs)))
    place = np.repeat(rows[:-1] - out_rows[:-1], runs) + np.arange(int(out_rows[-1]))
    left = np.repeat(rows[1:], runs) - place
    total = np.zeros(len(place), dtype=np.uint64)
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    step = powers(size + 1)
    for i in range(size):
        total += np.where(i < left, padded[place + i], np.uint64(7)) * step[i + 1]
    return mix(total), out_rows


def sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum per row; empty rows have 0."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[rows[1:]] - total[rows[:-1]]


def slices(batch: pa.RecordBatch, text: str | int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``limit`` bytes of text, or of one longer row."""
    index = text if isinstance(text, int) else batch.schema.get_field_index(text)
    _, offsets = raw(batch.column(index))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = max(at + 1, min(end, batch.num_rows))
        yield batch.slice(at, end - at)
        at = end


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts): one place of every distinct key, in the order of keys, and how often it is there."""
    order = np.argsort(keys)
    ordered = keys[order]
    begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(keys)])
    return order[begins], np.diff(np.append(begins, len(keys)))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether a key is there more than once, for every place."""
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    found = np.zeros(len(keys), dtype=bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def map_batches(
    df: DataFrame,
    added: dict[str, str],
    function: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    text: str,
    drop: tuple = (),
    limit: int = SLICE,
) -> DataFrame:
    """``df`` without ``drop`` and with the columns that ``function`` makes of Arrow batches.

    Batches are cut to about ``limit`` bytes of the ``text`` column.

    ``added`` gives their types. An added column replaces one of the same name.
    """
    lowered = {n.lower() for n in added}
    kept = [f for f in df.schema.fields if f.name not in drop and f.name.lower() not in lowered]
    names = [f.name for f in kept]
    more = T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in added.items()))
    schema = T.StructType([*kept, *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, text, limit)):
            made = function(batch)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, *made.values()], names=[*names, *made])

    return df.mapInArrow(run, schema)
