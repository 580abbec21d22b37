"""Language identification by multilingual mixture inference.

A text is taken as a mixture of languages: expectation-maximisation estimates how
much of it each language makes up from the likelihoods of its byte trigrams, and
the set of languages is the one with the best likelihood less a penalty for every
language in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wavebook.llm import texts
from wavebook.llm.common import fresh

# Trigrams are hashed into so many cells, so the model is that wide for any corpus.
CELL_BITS = 14
CELLS = 1 << CELL_BITS
SMOOTHING = 0.5

# Rounds of expectation-maximisation, and the log-likelihood a further language must add
# per log of the number of trigrams. Trigrams overlap, hence several times the usual half.
ROUNDS = 12
PENALTY = 3.0

# Likelihoods held at a time; a text has CELLS times the number of languages at most.
HELD = 1 << 22

UNKNOWN = "und"
ANY_LETTER = re.compile(r"[^\W\d_]")
OUTPUTS = {"lang_pred": "string", "score": "double", "langs": "array<struct<lang:string,share:double>>"}

# Letters stay (A-Z folded), all else counts as a blank.
_letters = texts.FOLD.copy()
_letters[[b for b in range(128) if not chr(b).isalpha()]] = 32


def cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, count): the trigrams of every text, blanks in a run counted once."""
    data, offsets = texts.raw(column)
    out_row, out_cell, out_count = [], [], []
    row = 0
    while row < len(offsets) - 1:
        # Texts are taken together up to a piece; a longer one is a piece of its own.
        end = int(np.searchsorted(offsets, offsets[row] + texts.PIECE, side="right")) - 1
        end = max(row + 1, min(end, len(offsets) - 1))
        n = end - row
        merged = np.zeros(0, dtype=np.int64)
        counts = np.zeros(0, dtype=np.int64)
        for low in range(int(offsets[row]), max(int(offsets[end]), int(offsets[row]) + 1), 8 * texts.PIECE):
            high = min(low + 8 * texts.PIECE + 2, int(offsets[end]))
            key = _keys(data[low:high], offsets[row : end + 1] - low)
            found, times = np.unique(np.concatenate((merged, key)), return_counts=True)
            times = times.astype(np.int64)
            if len(merged):
                back = np.searchsorted(found, merged)
                times[back] += counts - 1
            merged, counts = found, times
        out_row.append((merged >> CELL_BITS) + row)
        out_cell.append(merged & (CELLS - 1))
        out_count.append(counts)
        row = end
    if not out_row:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(out_row), np.concatenate(out_cell), np.concatenate(out_count)


def _keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """row * CELLS + cell of every trigram of some bytes."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    letters = _letters[data].astype(np.uint32)
    first, second, third = letters[:-2], letters[1:-1], letters[2:]
    cell = ((first * 65599 + second) * 65599 + third) * np.uint32(2654435761) >> np.uint32(32 - CELL_BITS)
    row = np.zeros(len(data) + 1, dtype=np.int64)
    inner = offsets[1:-1]
    np.add.at(row, inner[(inner >= 0) & (inner <= len(data))], 1)
    row = np.cumsum(row)[:-1] + int((inner < 0).sum())
    whole = (row[:-2] == row[2:]) & ~((first == 32) & (second == 32)) & ~((second == 32) & (third == 32))
    return (row[:-2][whole] << CELL_BITS) + cell[whole]


def has_letters(column: pa.Array) -> np.ndarray:
    """Whether a text has a letter of any script."""
    data, offsets = texts.raw(column)
    ascii_letter = np.zeros(256, dtype=bool)
    ascii_letter[[*range(65, 91), *range(97, 123)]] = True
    at = np.flatnonzero(ascii_letter[data])
    found = np.searchsorted(at, offsets[1:]) > np.searchsorted(at, offsets[:-1])
    for i in np.flatnonzero(~found):
        if offsets[i + 1] > offsets[i]:
            whole = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
            found[i] = ANY_LETTER.search(whole) is not None
    return found


def count_cells(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, cell, n): trigram counts per language, merged per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in texts.slices(whole, 0)):
            names = batch.column(1).dictionary_encode()
            order, which = names.dictionary.to_pylist(), names.indices.to_numpy().astype(np.int64)
            row, cell, count = cells(batch.column(0))
            sums = np.bincount(which[row] * CELLS + cell, weights=count, minlength=len(order) * CELLS)
            for i, name in enumerate(order):
                own = sums[i * CELLS : (i + 1) * CELLS].astype(np.int64)
                total[name] = total[name] + own if name in total else own
        for name, own in total.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(own[some], pa.int64())],
                names=["lang", "cell", "n"],
            )

    counted = df.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return (
        counted.mapInArrow(run, "lang string, cell int, n bigint")
        .groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    )


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log likelihoods by cell) from all rows with a language.

    Counts of all texts, brought to the driver as one row per language and cell.
    """
    rows = count_cells(df, text, lang).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(langs), CELLS))
    place = {name: i for i, name in enumerate(langs)}
    counts[rows["lang"].map(place).to_numpy(dtype=np.int64), rows["cell"].to_numpy()] = rows["n"].to_numpy()
    smooth = counts + SMOOTHING
    return langs, (smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)


def _row_sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=rows)


def _mixture(row, likely, count, rows, allowed) -> tuple[np.ndarray, np.ndarray]:
    """(shares, log-likelihood) of the allowed languages of every row.

    ``likely`` has the likelihood of each pair's cell in every language, ``allowed``
    the languages of each row's set.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    total = np.maximum(_row_sums(count, row, rows), 1)
    for _ in range(ROUNDS):
        part = likely * share[row]
        part *= (count / part.sum(axis=1))[:, None]
        share = np.stack([_row_sums(part[:, k], row, rows) for k in range(part.shape[1])], axis=1) / total[:, None]
    level = _row_sums(count * np.log((likely * share[row]).sum(axis=1)), row, rows)
    return share, level


def infer(row: np.ndarray, cell: np.ndarray, count: np.ndarray, rows: int, model: np.ndarray) -> np.ndarray:
    """Shares of the languages of every row; languages outside its set have 0.

    The set grows from the likeliest single language by the language with the next
    largest share in the mixture of all, as long as the likelihood gains more than
    the penalty.
    """
    n = len(model)
    likely = model[:, cell].T.astype(np.float64)
    alone = np.stack([_row_sums(count * np.log(likely[:, k]), row, rows) for k in range(n)], axis=1)
    best = np.zeros((rows, n))
    best[np.arange(rows), alone.argmax(axis=1)] = 1.0
    if n == 1:
        return best
    level = alone.max(axis=1)
    every, _ = _mixture(row, likely, count, rows, np.ones((rows, n)))
    # The likeliest language first, the others by their share in the mixture of all.
    rank = np.argsort(-(every + best * 2), axis=1, kind="stable")
    price = PENALTY * np.log(np.maximum(_row_sums(count, row, rows), 2))
    growing = np.arange(rows)
    for size in range(2, n + 1):
        # A language with less than a hundredth of a text cannot pay its price.
        growing = growing[every[growing, rank[growing, size - 1]] > 0.01]
        if not len(growing):
            break
        allowed = np.zeros((len(growing), n))
        np.put_along_axis(allowed, rank[growing, :size], 1.0, axis=1)
        place = np.full(rows, -1)
        place[growing] = np.arange(len(growing))
        own = place[row] >= 0
        share, now = _mixture(place[row[own]], likely[own], count[own], len(growing), allowed)
        better = now - level[growing] > price[growing]
        best[growing[better]] = share[better]
        level[growing[better]] = now[better]
        growing = growing[better]
    return best


def _predict(batch: pa.RecordBatch, text: str, model) -> dict[str, pa.Array]:
    langs, likelihoods = model.value
    column = batch.column(batch.schema.get_field_index(text))
    n = batch.num_rows
    lettered = has_letters(column)
    shares = np.zeros((n, len(langs)))
    if langs and n:
        row, cell, count = cells(column)
        pairs = max(1, HELD // len(langs))
        cut = [0]
        while cut[-1] < n:
            low = int(np.searchsorted(row, cut[-1]))
            whole = low + pairs >= len(row)
            cut.append(n if whole else max(int(row[low + pairs]), cut[-1] + 1))
        for first, last in zip(cut, cut[1:]):
            own = slice(*np.searchsorted(row, (first, last)))
            shares[first:last] = infer(row[own] - first, cell[own], count[own].astype(float), last - first, likelihoods)
    known = lettered & (shares.sum(axis=1) > 0)
    top = shares.argmax(axis=1) if langs else np.zeros(n, dtype=int)
    listed = [
        [{"lang": langs[k], "share": float(s[k])} for k in np.argsort(-s, kind="stable") if s[k] > 0] if ok else []
        for s, ok in zip(shares, known)
    ]
    return {
        "lang_pred": pa.array([langs[t] if ok else UNKNOWN for t, ok in zip(top, known)], pa.string()),
        "score": pa.array([min(1.0, float(s[t])) if ok else 0.0 for s, t, ok in zip(shares, top, known)], pa.float64()),
        "langs": pa.array(listed, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
    }


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``langs`` (the set with shares) to every row.

    ``lang_pred`` is the language with the largest share, ``score`` that share. A
    null text, one without letters, or any text with an empty model is ``und`` with
    score 0. Every trigram of a text counts, however long it is. Equal texts get
    equal results. An empty table gives no rows. Output columns replace input
    columns of the same name. The model has a fixed width and a row per language;
    it is broadcast.
    """
    carry = [c for c in (carry or df.columns) if c.lower() not in OUTPUTS]
    own, = [text] if text in carry else fresh(df, "_text")
    rows = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, text])]).withColumnRenamed(text, own)
    shared = df.sparkSession.sparkContext.broadcast(model)
    return texts.map_batches(rows, OUTPUTS, partial(_predict, text=own, model=shared), own, drop=() if own in carry else (own,))


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text modulo the number of folds."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
