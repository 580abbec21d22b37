"""Text quality by voting of the nearest labelled texts.

Texts become vectors of hashed terms, their words and the shapes of what stands
between blanks, weighted by inverse document frequency and projected on the leading
directions of the labelled texts (latent semantic analysis). The labelled vectors
are broadcast; cosines with all of them are exact, taken block by block, and the
nearest vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wavebook.llm import texts
from wavebook.llm.common import fresh

# Terms are hashed into so many cells.
CELL_BITS = 12
CELLS = 1 << CELL_BITS
DIRECTIONS = 64
NEIGHBOURS = 24
SHARPNESS = 8
THRESHOLD = 0.3

# Labelled texts learned from at most: those with the smallest hashes of their ids.
LABELLED = 4096

# Rows whose cosines are taken together.
BLOCK = 256

OUTPUTS = {"score": "double", "predicted": "int"}

# Classes of bytes for shapes: capitals, other letters, digits, each other byte itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[48:58] = 48

# Kinds of terms, told apart in the hash.
WORD, SHAPE, SHAPE_PAIR, REPEAT = (np.uint64(k * texts.BASE % (1 << 64)) for k in (1, 2, 3, 4))


def terms(column: pa.Array) -> np.ndarray:
    """Counts of hashed terms, a row per text."""
    data, offsets = texts.raw(column)
    n = len(offsets) - 1
    shape = _SHAPE[data]
    first = np.ones(len(data), dtype=bool)
    first[1:] = shape[1:] != shape[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    kept = np.concatenate(([0], np.cumsum(first)))[offsets]
    shapes, _, _, shape_rows = texts.words_of(shape[first], kept, texts.UNBLANK, texts.BYTE_VALUES)
    words, _, _, word_rows = texts.words_of(data, offsets, texts.LETTERS, texts.FOLDED_VALUES)
    total = np.zeros(n * CELLS)

    def add(hashes: np.ndarray, row: np.ndarray, kind: np.uint64) -> None:
        cell = (texts.mix(hashes ^ kind) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        np.add(total, np.bincount(row * CELLS + cell, minlength=n * CELLS), out=total)

    word_row = np.repeat(np.arange(n), np.diff(word_rows))
    shape_row = np.repeat(np.arange(n), np.diff(shape_rows))
    add(words, word_row, WORD)
    add(shapes, shape_row, SHAPE)
    near = shape_row[1:] == shape_row[:-1]
    add((shapes[1:] * np.uint64(texts.BASE) + shapes[:-1])[near], shape_row[1:][near], SHAPE_PAIR)
    again = (word_row[1:] == word_row[:-1]) & (words[1:] == words[:-1])
    add(np.zeros(int(again.sum()), np.uint64), word_row[1:][again], REPEAT)
    return total.reshape(n, CELLS)


def blocks(batches: Iterator[pa.RecordBatch], text: int | str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in texts.slices(whole, text):
            for at in range(0, part.num_rows, BLOCK):
                yield part.slice(at, BLOCK)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS + 1, dtype=np.int64)
    for batch in blocks(batches, 0):
        total[:CELLS] += (terms(batch.column(0)) > 0).sum(axis=0)
        total[CELLS] += batch.num_rows
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["cell", "n"])


def document_frequencies(df: DataFrame, text: str) -> np.ndarray:
    """Inverse document frequency of every cell over all texts; one number per cell."""
    found = (
        df.select(F.col(text).alias("text")).mapInArrow(_frequencies, "cell int, n bigint")
        .groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    )
    counts = np.zeros(CELLS + 1)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    return np.log((1 + counts[CELLS]) / (1 + counts[:CELLS])) + 0.1


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length; a repeated term counts by the root of its number."""
    return _unit(np.sqrt(counts) * idf)


def directions(rows: np.ndarray, count: int = DIRECTIONS) -> np.ndarray:
    """Leading right singular vectors, by a randomised range finder with power steps."""
    count = min(count, *rows.shape)
    random = np.random.Generator(np.random.PCG64(11)).standard_normal((rows.shape[1], min(rows.shape[1], count + 16)), dtype=np.float32)
    basis = np.linalg.qr(rows.T @ (rows @ random))[0]
    for _ in range(3):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    _, _, v = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ v.T)[:, :count]


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


class Model:
    """Weights, directions and the labelled vectors with their labels."""

    def __init__(self, idf: np.ndarray, counts: np.ndarray, labels: np.ndarray):
        rows = weighted(counts, idf).astype(np.float32)
        self.idf = idf
        self.directions = directions(rows) if len(labels) else np.zeros((CELLS, 1), np.float32)
        self.vectors = _unit(rows @ self.directions)
        self.labels = labels.astype(np.float64)
        # The vote of a text that is like no labelled one.
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        vectors = _unit(weighted(counts, self.idf).astype(np.float32) @ self.directions)
        cosine = vectors @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        nearest = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, nearest, axis=1), 0.0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        votes = (weight * self.labels[nearest]).sum(axis=1)
        return np.where(total > 0, votes / np.maximum(total, 1e-300), self.prior)


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, 0):
        counts = terms(batch.column(0))
        row, cell = np.nonzero(counts)
        offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(offsets, pa.array(cell.astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(counts[row, cell])),
                batch.column(1),
            ],
            names=["cells", "counts", "label"],
        )


def train(
    df: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", id_column: str = "doc_id", most: int = LABELLED
) -> Model:
    """Learn from up to ``most`` rows of ``labels``; term weights come from all texts of ``df``.

    The sample is the labels with the smallest hashes of their ids, so it is the
    same in every run and small enough to be broadcast to the texts. Labels that are
    null, or have no text, are left out; an id with two labels counts with both.
    """
    known = labels.where(F.col(label).isNotNull()).select(
        F.col(id_column).alias("_id"), F.col(label).cast("double").alias("label"), F.xxhash64(id_column).alias("_h")
    )
    sample = known.orderBy("_h", "label").limit(most)
    found = (
        df.select(F.col(id_column).alias("_doc"), F.col(text).alias("text"))
        .join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
        .select("text", "label")
        .mapInArrow(_example_terms, "cells array<int>, counts array<double>, label double")
        .toPandas()
    )
    counts = np.zeros((len(found), CELLS))
    for row, cells, values in zip(counts, found["cells"], found["counts"]):
        row[cells] = values
    order = np.lexsort((*counts.T[:8], found["label"].to_numpy())) if len(found) else slice(0)
    return Model(document_frequencies(df, text), counts[order], found["label"].to_numpy()[order])


def _vote(batch: pa.RecordBatch, text: str, model) -> dict[str, pa.Array]:
    column = batch.column(batch.schema.get_field_index(text))
    scores = np.zeros(batch.num_rows)
    for at in range(0, batch.num_rows, BLOCK):
        scores[at : at + BLOCK] = model.value.score(terms(column.slice(at, BLOCK)))
    scores = np.clip(scores, 0.0, 1.0)
    return {"score": pa.array(scores), "predicted": pa.array((scores >= THRESHOLD).astype(np.int32))}


def classify(df: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.3 on) to every row.

    A text without terms, as a null one, and any text with a model of no labels is
    scored by the share of good labels (a half without any). Equal texts score
    equally. An empty table gives no rows. Output columns replace input columns of
    the same name. The model's size is bounded by the cells, the directions and the
    labelled sample; it is broadcast.
    """
    carry = [c for c in (carry or df.columns) if c.lower() not in OUTPUTS]
    own, = [text] if text in carry else fresh(df, "_text")
    rows = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, text])]).withColumnRenamed(text, own)
    shared = df.sparkSession.sparkContext.broadcast(model)
    return texts.map_batches(rows, OUTPUTS, partial(_vote, text=own, model=shared), own, drop=() if own in carry else (own,))
