"""Fill-in-the-middle texts, assembled by a secondary sort.

A text is cut into prefix, middle and suffix between whole units. Its pieces, of a
bounded number of units each, are keyed by the row and by their position in the output,
dealt out by the row and sorted within partitions, so that a text comes as a stream
of pieces whatever its length. The stream goes into an incremental digest; what the marks in
it say gives every piece its position in the original, and one more sort within the
same partitions, without a shuffle, streams the text back into a second digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from wavebook.llm import texts
from wavebook.llm.common import shielded

# Units of a piece at most.
CHUNK_UNITS = 4096

# Bytes of text cut into pieces at a time.
SLICE_BYTES = 2 << 20

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
# The part of the original that follows a mark.
PART = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}

# Per cent of texts that stay plain, and of the others that put the suffix first.
PLAIN_FROM = 90
SPM_BELOW = 20

OUTPUTS = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]

LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True

HEAD_NAMES = ["n", "form", "prefix_chars", "middle_chars"]
HEAD = "n bigint, form string, prefix_chars bigint, middle_chars bigint"


def draws(id_column: str, seed: int = 1) -> list[Column]:
    """Four numbers of a row: the 8-digit groups of a digest of seed and id (null: no digits)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") for at in (1, 9, 17, 25)]


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, rows): where units begin in the bytes, and the first unit of every row."""
    letter = LETTER[data]
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = letter[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    inner = (data & 0xC0) == 0x80
    starts = np.flatnonzero((letter & ~before) | ~(letter | inner))
    return starts, np.searchsorted(starts, offsets)


def _cut(batches: Iterator[pa.RecordBatch], carry: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of (row, text, four draws, carry) as pieces in the order of the output.

    The piece at position -1 has no data; it carries the row's columns.
    """
    for batch in (part for whole in batches for part in texts.slices(whole, "text", SLICE_BYTES)):
        column = batch.column(1)
        data, offsets = texts.raw(column)
        starts, first = _units(data, offsets)
        starts = np.append(starts, len(data))
        count = np.diff(first)
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        h = [batch.column(2 + i).to_numpy() for i in range(4)]
        one, two = h[0] % (count + 1), h[1] % (count + 1)
        cuts = np.minimum(one, two), np.maximum(one, two)
        marked = np.zeros(batch.num_rows, dtype=bool)
        for mark in PART:
            found = pc.match_substring(pc.fill_null(column, ""), mark.decode())
            marked |= found.to_numpy(zero_copy_only=False)
        plain = (count == 0) | marked | (h[2] % 100 >= PLAIN_FROM)
        form = np.where(plain, "plain", np.where(h[3] % 100 < SPM_BELOW, "spm", "psm"))

        def byte(row: np.ndarray, unit: np.ndarray) -> np.ndarray:
            return np.where(unit < count[row], starts[np.minimum(first[row] + unit, len(starts) - 1)], offsets[row + 1])

        every = np.arange(batch.num_rows)
        ends = [offsets[:-1], byte(every, cuts[0]), byte(every, cuts[1]), offsets[1:]]
        chars = [points[ends[i + 1]] - points[ends[i]] for i in (0, 1)]
        whole = data.tobytes()
        source, position, pieces = [], [], []

        def emit(row: int, units: tuple[int, int]) -> None:
            low, high = units
            at = list(range(low, high, CHUNK_UNITS))
            edges = [int(starts[first[row] + u]) for u in at] + [int(offsets[row + 1]) if high == count[row] else int(starts[first[row] + high])]
            for a, b in zip(edges, edges[1:]):
                add(row, whole[a:b])

        def add(row: int, piece: bytes | None) -> None:
            position.append(position[-1] + 1 if source and source[-1] == row else -1)
            source.append(row)
            pieces.append(piece)

        for row in range(batch.num_rows):
            add(row, None)
            low, high, n = int(cuts[0][row]), int(cuts[1][row]), int(count[row])
            if form[row] == "plain":
                emit(row, (0, n))
                continue
            parts = {PREFIX: (0, low), MIDDLE: (low, high), SUFFIX: (high, n)}
            for mark in ORDER[str(form[row])]:
                add(row, mark)
                emit(row, parts[mark])
        head = np.array([p is None for p in pieces], dtype=bool)
        of = np.array(source, dtype=np.int64)
        at_head = pa.array(of, mask=~head)
        details = [pa.array(count, pa.int64()), pa.array(form), *(pa.array(c, pa.int64(), mask=plain) for c in chars)]
        columns = [batch.column(0).take(pa.array(of)), pa.array(position, pa.int32()), pa.array(pieces, pa.binary())]
        columns += [x.take(at_head) for x in details] + [batch.column(6 + i).take(at_head) for i in range(len(carry))]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "position", "piece", *HEAD_NAMES, *carry])


def _read_output(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of the output, with the part of the original each belongs to.

    Marks end here. After the last piece of a row comes its digest, in part -1 at
    position 0, and with ``keep`` the output itself.
    """
    row, digest, plain, part, held = None, None, False, 0, []

    def ended() -> tuple:
        return row, -1, 0, b"".join(held) if keep else None, digest.hexdigest()

    for batch in batches:
        out = []
        index = []
        rows, positions, pieces = (batch.column(i).to_pylist() for i in range(3))
        forms = batch.column(4)
        for i, (of, position, piece) in enumerate(zip(rows, positions, pieces)):
            if position < 0:
                if row is not None:
                    out.append(ended())
                    index.append(None)
                row, digest, part, held = of, hashlib.sha256(), 0, []
                plain = forms[i].as_py() == "plain"
                out.append((of, -1, -1, None, None))
                index.append(i)
                continue
            digest.update(piece)
            if keep:
                held.append(piece)
            if not plain and piece in PART:
                part = PART[piece]
            else:
                out.append((of, part, position, piece, None))
                index.append(None)
        yield _parts(batch, out, index)
    if row is not None:
        yield _parts(batch, [ended()], [None])


def _parts(batch: pa.RecordBatch, out: list[tuple], index: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
    at = pa.array(index, pa.int64())
    others = batch.schema.names[3:]
    return pa.RecordBatch.from_arrays(
        [*columns, *(batch.column(3 + i).take(at) for i in range(len(others)))],
        names=["row", "part", "position", "piece", "output_sha256", *others],
    )


def _restore(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """One row per text from its pieces in the original order: both digests and its columns."""
    head, output, whole, digest = None, None, None, None

    def ended(heads: list[pa.RecordBatch], outputs: list, wholes: list, digests: list) -> pa.RecordBatch:
        found = pa.Table.from_batches(heads).combine_chunks().to_batches()[0]
        columns = [*found.columns, pa.array(outputs, pa.string()), pa.array(digests, pa.string())]
        names = [*found.schema.names, "output_sha256", "restored_sha256"]
        if keep:
            columns.append(pa.array(wholes, pa.binary()).cast(pa.string()))
            names.append("output")
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        done: tuple[list, list, list, list] = ([], [], [], [])
        parts, positions, pieces, outputs = (batch.column(i).to_pylist() for i in (1, 2, 3, 4))
        others = batch.select(batch.schema.names[5:])
        first = None
        for i, (part, position, piece, of) in enumerate(zip(parts, positions, pieces, outputs)):
            if part >= 0:
                digest.update(piece)
            elif position == 0:
                output, whole = of, piece
            else:
                if digest is not None:
                    for values, value in zip(done, (head if first is None else others.slice(first, 1), output, whole, digest.hexdigest())):
                        values.append(value)
                first, digest = i, hashlib.sha256()
        if done[0]:
            yield ended(*done)
        if first is not None:
            head = others.slice(first, 1)
    if digest is not None:
        yield ended([head], [output], [whole], [digest.hexdigest()])


@shielded("text", "id_column", outputs=[*OUTPUTS, "output"])
def fill_in_middle(
    df: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    carry: list[str] | None = None,
    seed: int = 1,
    keep_output: bool = False,
) -> DataFrame:
    """Turn texts into fill-in-the-middle form, and back.

    Units are runs of A-Z and a-z and single other characters. Returns the ``carry``
    columns (all by default) with ``n`` (units), ``form`` (``plain``, ``psm`` or
    ``spm``), ``prefix_chars`` and ``middle_chars`` (code points, null if plain), the
    SHA-256 of the output and of the text restored from the output and the form
    alone, and with ``keep_output`` the ``output`` itself.

    Cuts and forms follow from ``seed`` and the id only; rows with a missing id all
    have the same draws, and repeated rows come out the same. An empty or null text is
    plain, its output empty; so is a text that has a mark already. A text of any length is
    a stream of bounded pieces, except where ``keep_output`` puts it together.
    Columns of any name are carried; those of the outputs' names are replaced. An
    empty table gives no rows.

    Rows are numbered as they are read, so a task that runs again must read the same
    rows in the same order: give a table or a stored frame.
    """
    rows = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"),
        *[h.alias(f"h{i}") for i, h in enumerate(draws(id_column, seed))], *carry,
    )
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*carry).schema)
    columns = HEAD + (", " + carried if carried else "")
    pieces = rows.mapInArrow(partial(_cut, carry=carry), f"row bigint, position int, piece binary, {columns}")
    # One shuffle; both sorts are within its partitions.
    streams = pieces.repartition("row").sortWithinPartitions("row", "position")
    parts = streams.mapInArrow(
        partial(_read_output, keep=keep_output), f"row bigint, part int, position int, piece binary, output_sha256 string, {columns}"
    )
    more = ", output string" if keep_output else ""
    found = parts.sortWithinPartitions("row", "part", "position").mapInArrow(
        partial(_restore, keep=keep_output), f"{columns}, output_sha256 string, restored_sha256 string{more}"
    )
    return found.select(*carry, *OUTPUTS, *(["output"] if keep_output else []))


def restored(output: str, form: str) -> Column:
    """The original text of an output in a form, as an expression over whole texts."""
    prefix, suffix, middle = (m.decode() for m in (PREFIX, SUFFIX, MIDDLE))
    psm = rf"(?s)^{prefix}(.*){suffix}(.*){middle}(.*)$"
    spm = rf"(?s)^{suffix}(.*){prefix}(.*){middle}(.*)$"
    return (
        F.when(F.col(form) == "psm", F.regexp_replace(output, psm, "$1$3$2"))
        .when(F.col(form) == "spm", F.regexp_replace(output, spm, "$2$3$1"))
        .otherwise(F.col(output))
    )
