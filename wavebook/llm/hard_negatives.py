"""Hard negatives by rotated one-bit codes with stored alignments.

A vector is rotated at random and kept as the signs of its components, one bit each,
with its norm and its alignment, the cosine between vector and code. What the code leaves
over is coded again in the same way, a few times. The inner product with an anchor is
estimated by popcounts between a vector's bits and the bit planes of the anchor,
and the Cauchy-Schwarz inequality bounds what anchor and remainder can add: an interval
that always holds. Vectors whose interval cannot reach the result are dropped after each
code; the rest are scored with their whole numbers, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wavebook.llm import texts
from wavebook.llm.common import shielded, store

# Codes of a vector, each of what the ones before leave over.
LEVELS = 4

# Bits of an anchor's component in the popcounts.
PLANES = 8

# Anchors meet rows in blocks of so many, and rows come in chunks of so many.
BLOCK_ANCHORS = 4096
CHUNK_ROWS = 8192

# Whole numbers up to this are exact in double precision.
EXACT = float(1 << 53)

POSITIVES = 5
NEGATIVES = 3
# Per cent of the positive's score that a negative has at least and at most.
LEAST, MOST = 50, 95

OUTPUTS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def rotations(words: int, levels: int = LEVELS, seed: int = 11) -> list[np.ndarray]:
    """Random orthogonal matrices for vectors of 64 components a word."""
    draw = np.random.Generator(np.random.PCG64(seed))
    return [np.linalg.qr(draw.standard_normal((64 * words, 64 * words)))[0] for _ in range(levels)]


def _padded(vectors: np.ndarray, turns: list[np.ndarray]) -> np.ndarray:
    return np.pad(vectors.astype(np.float64), ((0, 0), (0, len(turns[0]) - vectors.shape[1])))


def encode(vectors: np.ndarray, turns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits, norms, alignments) of whole-number vectors: per level the packed signs, the
    alignment, and the norm of the vector and of what each level leaves over."""
    left = _padded(vectors, turns)
    n, size = left.shape
    bits = np.empty((n, len(turns), size // 64), dtype=np.uint64)
    norms = np.empty((n, len(turns) + 1))
    alignments = np.empty((n, len(turns)))
    norms[:, 0] = np.sqrt((left * left).sum(axis=1))
    for level, turn in enumerate(turns):
        rotated = left @ turn
        sign = np.where(rotated >= 0, 1.0, -1.0)
        bits[:, level] = np.packbits(rotated >= 0, axis=1, bitorder="little").view(np.uint64)
        along = np.abs(rotated).sum(axis=1) / np.sqrt(size)
        norm = norms[:, level]
        alignments[:, level] = np.divide(along, norm, out=np.zeros(n), where=norm > 0)
        left = left - (sign * (along / np.sqrt(size))[:, None]) @ turn.T
        norms[:, level + 1] = np.sqrt((left * left).sum(axis=1))
    return bits, norms, alignments


class Anchor:
    """The bit planes of an anchor's rotated vectors, and what rounding them leaves over."""

    def __init__(self, vector: np.ndarray, turns: list[np.ndarray]):
        whole = _padded(vector[None, :], turns)[0]
        self.norm = float(np.sqrt(whole @ whole))
        self.levels = []
        for turn in turns:
            rotated = whole @ turn
            low, high = float(rotated.min()), float(rotated.max())
            step = (high - low) / ((1 << PLANES) - 1) or 1.0
            units = np.rint((rotated - low) / step)
            off = float(np.sqrt(((rotated - low - step * units) ** 2).sum()))
            of = units.astype(np.uint64)
            planes = np.stack([
                np.packbits((of >> np.uint64(p)) & np.uint64(1), bitorder="little").view(np.uint64) for p in range(PLANES)
            ])
            self.levels.append((low, step, float(units.sum()), planes, off))

    def along(self, level: int, bits: np.ndarray) -> tuple[np.ndarray, float]:
        """Inner products with the codes of a level, as unit vectors, and the most they are off."""
        low, step, total, planes, off = self.levels[level]
        size = 64 * bits.shape[1]
        ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        weighted = np.zeros(len(bits), dtype=np.int64)
        for p, plane in enumerate(planes):
            weighted += np.bitwise_count(bits & plane).sum(axis=1, dtype=np.int64) << p
        return (low * (2.0 * ones - size) + step * (2.0 * weighted - total)) / np.sqrt(size), off


def survivors(anchor: Anchor, at: np.ndarray, coded: tuple, possible) -> np.ndarray:
    """The places of ``at`` whose interval stays ``possible(low, high)`` after every level."""
    bits, norms, alignments = coded
    estimate, spread = np.zeros(len(at)), np.zeros(len(at))
    for level in range(bits.shape[1]):
        if not len(at):
            break
        along, off = anchor.along(level, bits[at, level])
        scale = norms[at, level] * alignments[at, level]
        estimate += scale * along
        spread += scale * off
        sure = np.maximum(np.abs(along) - off, 0.0)
        beside = np.sqrt(np.maximum(anchor.norm**2 - sure**2, 0.0))
        # Rounding of doubles is far below this.
        reach = spread + beside * norms[at, level + 1] + 1e-9 * (1.0 + anchor.norm * norms[at, 0])
        keep = possible(estimate - reach, estimate + reach)
        at, estimate, spread = at[keep], estimate[keep], spread[keep]
    return at


class Best:
    """The first ``most`` (score, id) of a search so far: higher scores, then smaller ids, no id last."""

    def __init__(self, most: int):
        self.most = most
        self.rows: list[tuple] = []
        self.floor = -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray, rows: np.ndarray) -> None:
        if len(scores) > self.most:
            last = np.partition(scores, len(scores) - self.most)[len(scores) - self.most]
            some = np.flatnonzero(scores >= max(last, self.floor))
        else:
            some = np.arange(len(scores))
        order = np.lexsort((rows[some], ids[some], missing[some], -scores[some]))[: self.most]
        more = [(-int(scores[i]), bool(missing[i]), int(ids[i]), int(rows[i])) for i in some[order]]
        self.rows = sorted(self.rows + more)[: self.most]
        if len(self.rows) == self.most:
            self.floor = float(-self.rows[-1][0])


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return _bytes(column).view(np.int64).reshape(len(column), size)


def _bytes(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(texts.raw(column)[0])


def _encode(batches: Iterator[pa.RecordBatch], size: int, turns) -> Iterator[pa.RecordBatch]:
    """(row, vec_id, label, vector) with the vector as bytes, padded with zeros, and its codes."""
    for batch in batches:
        lists = batch.column(3)
        vectors = np.zeros((batch.num_rows, size), dtype=np.int64)
        lengths = np.diff(lists.offsets.to_numpy())
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        vectors[np.repeat(np.arange(batch.num_rows), lengths), place] = lists.flatten().to_numpy()
        bits, norms, alignments = encode(vectors, turns.value)
        columns = [pa.array([x.tobytes() for x in part], pa.binary()) for part in (vectors, bits, norms, alignments)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], *columns], names=["row", "vec_id", "label", "vector", "bits", "norms", "alignments"]
        )


CODES = "vector binary, bits binary, norms binary, alignments binary"


def _search(batches: Iterator[pa.RecordBatch], size: int, levels: int, turns, most: int, exact: bool, kind: str) -> Iterator[pa.RecordBatch]:
    """The best rows of a chunk for the anchors of a block.

    Rows come by block and chunk, anchors (which have targets) first. ``kind`` is
    ``same`` for rows of the anchor's label, or ``other`` for rows of other labels with
    scores in the range of each target.
    """
    group, anchors = None, []
    for batch in batches:
        n = batch.num_rows
        block, chunk, row = (batch.column(i).to_numpy() for i in (0, 1, 3))
        leads = batch.column(2).to_numpy(zero_copy_only=False)
        missing = batch.column(4).is_null().to_numpy(zero_copy_only=False)
        ids = batch.column(4).fill_null(0).to_numpy()
        labels = batch.column(5).to_numpy()
        vectors = _vectors(batch.column(6), size)
        coded = (
            _bytes(batch.column(7)).view(np.uint64).reshape(n, levels, -1),
            _bytes(batch.column(8)).view(np.float64).reshape(n, levels + 1),
            _bytes(batch.column(9)).view(np.float64).reshape(n, levels),
        )
        targets = batch.column(10)
        edges = np.flatnonzero((block[1:] != block[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        for low, high in zip([0, *edges], [*edges, n]):
            if group != (block[low], chunk[low]):
                yield from _found(anchors)
                group, anchors = (block[low], chunk[low]), []
            lead = np.flatnonzero(leads[low:high]) + low
            for i in lead:
                wanted = targets[int(i)].as_py()
                anchors.append((int(row[i]), int(labels[i]), vectors[i].copy(), Anchor(vectors[i], turns.value),
                                [(p, t, Best(most)) for p, t in enumerate(wanted)]))
            own = np.flatnonzero(~leads[low:high]) + low
            for anchor in anchors:
                _meet(anchor, own, row, ids, missing, labels, vectors, coded, exact, kind)
    yield from _found(anchors)


def _meet(anchor: tuple, own, row, ids, missing, labels, vectors, coded, exact: bool, kind: str) -> None:
    """Add the rows of a batch to the best ones of an anchor."""
    number, label, vector, codes, wanted = anchor
    if not wanted:
        return
    if kind == "same":
        at = own[(labels[own] == label) & (row[own] != number)]
        ranges = [(-np.inf, np.inf)]
    else:
        at = own[labels[own] != label]
        ranges = [(t * LEAST / 100, t * MOST / 100) for _, t, _ in wanted]
    # A row must reach the floor of one search at least, and not be above its range.
    floors = [max(low, best.floor) for (low, _), (_, _, best) in zip(ranges, wanted)]
    floor, top = min(floors), max(high for _, high in ranges)
    at = survivors(codes, at, coded, lambda low, high: (high >= floor) & (low <= top))
    if not len(at):
        return
    if exact:
        scores = np.rint(vectors[at].astype(np.float64) @ vector.astype(np.float64)).astype(np.int64)
    else:
        scores = np.array((vectors[at].astype(object) @ vector.astype(object)).tolist(), dtype=np.int64)
    for (_, target, best), least in zip(wanted, floors):
        if kind == "same":
            fits = scores >= least
        else:
            fits = (scores >= least) & (LEAST * target <= 100 * scores) & (100 * scores <= MOST * target)
        some = np.flatnonzero(fits)
        if len(some):
            best.add(scores[some], ids[at[some]], missing[at[some]], row[at[some]])


def _found(anchors: list[tuple]) -> Iterator[pa.RecordBatch]:
    rows = [
        (number, place, None if missing else vec_id, -score, row)
        for number, _, _, _, wanted in anchors
        for place, _, best in wanted
        for score, missing, vec_id, row in best.rows
    ]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
        names=["anchor", "place", "vec_id", "score", "row"],
    )


def _dealt(coded: DataFrame, anchors: DataFrame, blocks: int, chunks: int) -> DataFrame:
    """Every block of anchors with every chunk of rows, anchors first.

    ``anchors`` has (row, targets, all of a coded row). A chunk of rows is copied to
    every block, a block of anchors to every chunk; both are of bounded size.
    """
    names = ["block", "chunk", "leads", "row", "vec_id", "label", "vector", "bits", "norms", "alignments", "targets"]
    block = F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)).cast("int")
    chunk = F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")
    leading = anchors.withColumn("leads", F.lit(True)).withColumn("block", block).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    )
    rows = coded.withColumn("leads", F.lit(False)).withColumn("chunk", chunk).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    ).withColumn("targets", F.lit(None).cast("array<bigint>"))
    return leading.select(*names).unionByName(rows.select(*names)).repartition("block", "chunk").sortWithinPartitions(
        "block", "chunk", F.col("leads").desc()
    )


def _first(found: DataFrame, keys: list[str], most: int, place: str) -> DataFrame:
    """The first rows of every search over all chunks; Spark keeps as many of each task only."""
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"]
    ranked = found.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(place) <= most)


@shielded("id_column", "embedding", "label", outputs=OUTPUTS)
def hard_negatives(
    df: DataFrame,
    every: int,
    id_column: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
) -> DataFrame:
    """Rows of other labels that are nearly as close to an anchor as its positives.

    Anchors are the rows whose id is divisible by ``every``. A component ``x`` counts as
    ``floor(256 * x)``, a score is the inner product of such vectors. The positives of an
    anchor are its first rows of the same label, itself left out; for each, the first
    rows of other labels are returned whose score is between 50 and 95 per cent of the
    positive's. Higher scores come first, ties by the smaller id, rows without an id last.

    Returns ``anchor_id``, ``positive_id``, ``rank`` from 1, ``negative_id`` and both
    scores. Rows with a missing label or
    vector, or a component that is missing or not finite, take no part. A row without an
    id is no anchor, but may be found. Rows that share an id are rows of their own, anchors
    included. Shorter vectors are filled up with zeros. Vectors of zeros score 0 with all,
    and a positive of a negative score has no negatives. An empty table, or one without
    anchors, gives no rows. Scores beyond 64 bits are an error.

    Coded rows are stored once in the shared checkpoint folder. Anchors meet rows in
    bounded blocks and chunks; a task holds the best few rows of a block's anchors.
    """
    whole = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * 256.0))
    finite = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.where(F.col(label).isNotNull() & F.col(embedding).isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("bigint").alias("vec_id"),
        F.col(label).cast("bigint").alias("label"), whole.alias("vector"),
    )
    biggest = F.max(F.array_max(F.transform("vector", F.abs)))
    is_anchor = F.col("vec_id") % every == 0
    seen = rows.agg(
        F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("size"), F.coalesce(biggest, F.lit(0)).alias("most"),
        F.count("*").alias("rows"), F.count(F.when(is_anchor, 1)).alias("anchors"),
    ).first()
    words = max(1, -(-seen.size // 64))
    size = 64 * words
    exact = float(seen.most) ** 2 * size < EXACT
    turns = df.sparkSession.sparkContext.broadcast(rotations(words))
    coded = store(rows.mapInArrow(partial(_encode, size=size, turns=turns), f"row bigint, vec_id bigint, label bigint, {CODES}"))
    blocks, chunks = (max(1, -(-n // most)) for n, most in ((seen.anchors, BLOCK_ANCHORS), (seen.rows, CHUNK_ROWS)))

    def searched(anchors: DataFrame, most: int, kind: str) -> DataFrame:
        search = partial(_search, size=size, levels=LEVELS, turns=turns, most=most, exact=exact, kind=kind)
        return _dealt(coded, anchors, blocks, chunks).mapInArrow(
            search, "anchor bigint, place int, vec_id bigint, score bigint, row bigint"
        )

    anchors = coded.where(is_anchor)
    near = searched(anchors.withColumn("targets", F.array(F.lit(0).cast("bigint"))), positives, "same")
    best = store(_first(near, ["anchor"], positives, "nth").select("anchor", "nth", "vec_id", "score"))
    # At most ``positives`` rows a group.
    listed = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "score"))).alias("list"))
    aimed = anchors.join(listed.withColumnRenamed("anchor", "row"), "row").withColumn("targets", F.col("list.score"))
    far = searched(aimed, negatives, "other")
    chosen = _first(far, ["anchor", "place"], negatives, "rank").select(
        "anchor", (F.col("place") + 1).alias("nth"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    named = best.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"})
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return chosen.join(named, ["anchor", "nth"]).join(ids, "anchor").select(*OUTPUTS)
