"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are windows of ten consecutive words of a benchmark item. The search
looks at the last two words of a text window: a table says how far the window can
move on before any test string could end there. Where it cannot move, the strings
that end in these two words are found in a bucket and compared word by word. Words
are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wavebook.llm import texts
from wavebook.llm.common import fresh, materialise

WINDOW = 10
BLOCK = 2

# Benchmark bytes searched for in one pass; a larger benchmark takes several passes.
PASS_BYTES = 16 << 20

# Positions a scan follows one after the other; scans of many stretches go side by side.
STRETCH = 256

OUTPUTS = {
    "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string",
    "contaminated": "boolean", "item_ids": "array<string>", "spans": "array<struct<start:int,end:int>>",
}


class Patterns:
    """Search tables for word strings of one length."""

    def __init__(self, strings: np.ndarray, items: list[np.ndarray]):
        """``strings`` has a row of hashes per string, ``items`` the item numbers of each."""
        self.length = strings.shape[1]
        self.block = min(BLOCK, self.length)
        tails = self.blocks(strings[:, -self.block :])
        order = np.argsort(tails, kind="stable")
        self.tails, self.strings = tails[order], strings[order]
        counts = np.array([len(items[i]) for i in order], dtype=np.int64)
        self.item_rows = np.concatenate(([0], np.cumsum(counts)))
        self.items = np.concatenate([items[i] for i in order]) if len(order) else np.zeros(0, np.int64)
        # Sixteen cells or more for each block keep chance collisions, which only cost time, rare.
        bits = min(24, max(16, math.ceil(math.log2(max(2, strings.size))) + 4))
        self.down = np.uint64(64 - bits)
        farthest = min(255, self.length - self.block + 1)
        self.shift = np.full(1 << bits, farthest, dtype=np.uint8)
        for end in range(self.block - 1, self.length):
            cells = self.blocks(strings[:, end - self.block + 1 : end + 1]) >> self.down
            np.minimum.at(self.shift, cells.astype(np.int64), min(255, self.length - 1 - end))

    def blocks(self, words: np.ndarray) -> np.ndarray:
        total = np.zeros(len(words), dtype=np.uint64)
        for i in range(self.block):
            total = total * np.uint64(texts.BASE) + words[:, i]
        return texts.mix(total)

    def blocks_at(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.zeros(len(ends), dtype=np.uint64)
        for i in range(self.block):
            total = total * np.uint64(texts.BASE) + hashes[ends - (self.block - 1) + i]
        return texts.mix(total)

    def candidates(self, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Ends of windows that the shift table cannot rule out."""
        counts = np.diff(rows) - self.length + 1
        stretches = np.maximum(0, -(-counts // STRETCH))
        row = np.repeat(np.arange(len(counts)), stretches)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        at = rows[:-1][row] + self.length - 1 + nth * STRETCH
        limit = np.minimum(at + STRETCH, rows[1:][row])
        found = []
        while len(at):
            step = self.shift[(self.blocks_at(hashes, at) >> self.down).astype(np.int64)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < limit
            at, limit = at[live], limit[live]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def search(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ends, strings): every occurrence, by the end of its window."""
        if not len(self.strings) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = self.candidates(hashes, rows)
        tails = self.blocks_at(hashes, at)
        low, high = np.searchsorted(self.tails, tails), np.searchsorted(self.tails, tails, side="right")
        some = high > low
        at, low, size = at[some], low[some], (high - low)[some]
        ends = np.repeat(at, size)
        strings = np.repeat(low, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        for i in range(self.length):
            same = hashes[ends - self.length + 1 + i] == self.strings[strings, i]
            ends, strings = ends[same], strings[same]
        return ends, strings


def build(items: list[tuple[str, str]], window: int = WINDOW) -> tuple[list[Patterns], list[str]]:
    """Search tables, one per string length, and the item ids; items are (id, text)."""
    items = [(i, t) for i, t in items if t]
    ids = sorted({i for i, _ in items})
    number = {i: n for n, i in enumerate(ids)}
    hashes, _, _, rows = texts.words(pa.array([t for _, t in items], type=pa.string()))
    found: dict[int, dict[bytes, set[int]]] = {}
    for (item, _), low, high in zip(items, rows, rows[1:]):
        size = min(window, high - low)
        if size:
            own = found.setdefault(int(size), {})
            for at in range(low, high - size + 1):
                own.setdefault(hashes[at : at + size].tobytes(), set()).add(number[item])
    tables = []
    for size, own in sorted(found.items()):
        strings = np.frombuffer(b"".join(own), dtype=np.uint64).reshape(-1, size)
        tables.append(Patterns(strings, [np.array(sorted(s), dtype=np.int64) for s in own.values()]))
    return tables, ids


def _runs(covered: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of maximal covered runs, counted from the begin of the row."""
    before = np.concatenate(([False], covered[:-1]))
    after = np.concatenate((covered[1:], [False]))
    begins, ends = rows[:-1], rows[1:]
    before[begins[begins < len(covered)]] = False
    after[ends[ends > 0] - 1] = False
    start, end = np.flatnonzero(covered & ~before), np.flatnonzero(covered & ~after) + 1
    row = np.searchsorted(rows, start, side="right") - 1
    return row, start - rows[row], end - rows[row]


def _scan(batch: pa.RecordBatch, text: str, tables) -> dict[str, pa.Array]:
    """Word counts, hit spans and items of a batch, joined with those of an earlier pass."""
    patterns, ids = tables.value
    hashes, _, _, rows = texts.words(batch.column(batch.schema.get_field_index(text)))
    n = batch.num_rows
    edges = np.zeros(len(hashes) + 1, dtype=np.int64)
    items: list[set] = [set(x) for x in batch.column(batch.schema.get_field_index("item_ids")).to_pylist()]
    for row, spans in enumerate(batch.column(batch.schema.get_field_index("spans")).to_pylist()):
        for s in spans:
            edges[rows[row] + s["start"]] += 1
            edges[rows[row] + s["end"]] -= 1
    for p in patterns:
        ends, strings = p.search(hashes, rows)
        np.add.at(edges, ends - p.length + 1, 1)
        np.add.at(edges, ends + 1, -1)
        row = np.searchsorted(rows, ends, side="right") - 1
        for r, s in np.unique(np.stack([row, strings]), axis=1).T if len(ends) else []:
            items[r].update(ids[i] for i in p.items[p.item_rows[s] : p.item_rows[s + 1]])
    covered = np.cumsum(edges[:-1]) > 0
    row, start, end = _runs(covered, rows) if len(covered) else (np.zeros(0, np.int64),) * 3
    listed = [sorted(s) for s in items]
    offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays(
        [pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["start", "end"]
    )
    hit = texts.sums(covered.astype(np.int64), rows)
    sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed]
    return {
        "n_words": pa.array(np.diff(rows), pa.int64()),
        "n_hit": pa.array(hit, pa.int64()),
        "n_items": pa.array([len(x) for x in listed], pa.int64()),
        "items_sha256": pa.array(sha, pa.string()),
        "contaminated": pa.array(hit > 0),
        "item_ids": pa.array(listed, pa.list_(pa.string())),
        "spans": pa.ListArray.from_arrays(pa.array(offsets), spans),
    }


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    carry: list[str] | None = None,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """Add what of every text occurs in the benchmark.

    Returns the ``carry`` columns (all by default) with ``n_words``, ``n_hit``
    (words inside an occurrence of a test string), ``n_items``, ``items_sha256``
    (of the sorted item ids, joined by commas), ``contaminated``, ``item_ids`` and
    the hit ``spans`` in words. Letters A-Z are lower-cased; words are runs of
    letters, digits and characters beyond ASCII. An item of fewer than ten words,
    but not none, is one test string.

    Null texts have no words; null or empty items and items with a null id give no
    string; equal items count by their ids. An empty table gives no rows. Output
    columns replace input columns of the same name. The search tables of
    ``pass_bytes`` of benchmark are broadcast; a larger benchmark is searched for
    in several passes, each over the whole texts, the rows being stored between.
    """
    carry = [c for c in (carry or df.columns) if c.lower() not in OUTPUTS]
    spark = df.sparkSession
    items = benchmark.where(F.col(item_id).isNotNull()).select(
        F.col(item_id).cast("string").alias("id"), F.coalesce(item_text, F.lit("")).alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    passes = max(1, math.ceil(size / pass_bytes))
    own, = [text] if text in carry else fresh(df, "_text")
    rows = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, text])]).withColumnRenamed(text, own).withColumns(
        {"item_ids": F.array().cast("array<string>"), "spans": F.array().cast(OUTPUTS["spans"])}
    )
    for n in range(passes):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == n)
        tables = spark.sparkContext.broadcast(build([(r.id, r.text) for r in part.collect()]))
        final = n == passes - 1
        rows = texts.map_batches(rows, OUTPUTS, partial(_scan, text=own, tables=tables), own, drop=(own,) if final and own not in carry else ())
        if not final:
            rows = materialise(rows)
    return rows
