"""Secrets in texts, told from examples by who owns their copies.

Every text is scanned for values that look like credentials. What a value looks like
does not say whether it is live: a key in a manual is copied by everybody. So the
digests of all values are counted over the whole corpus, by distinct repositories and
distinct owners: a value of one or two owners is taken for a live credential, one that many
owners have for an example.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wavebook.llm import texts
from wavebook.llm.common import join_counted, shielded, store

# Kinds in the order of the report. The first three are always reported, a run only if it
# belongs to few owners.
KINDS = ("assign", "access", "hex", "run")
BASE_KINDS = 3

# What the three patterns look for.
ASSIGN = re.compile(
    rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

# A run is that long, has a letter and a digit, and so many bits of entropy a character.
RUN_LEAST = 20
RUN_BITS = 3.0

# Owners that a live credential has at most.
MOST_OWNERS = 2

HEX = np.zeros(256, dtype=bool)
HEX[[*range(48, 58), *range(97, 103)]] = True
RUN = np.zeros(256, dtype=bool)
RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-"]] = True

OUTPUTS = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "live_spans", "n_live", "n_copied"]
FOUND = "array<struct<start:int,kind:int,end:int,secret:binary>>"


def long_runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of bytes of a class, of so many at least; none goes across rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = inside[data]
    breaks = offsets[:-1][offsets[:-1] < len(data)]
    before = np.concatenate(([False], word[:-1]))
    before[breaks] = False
    after = np.concatenate((word[1:], [False]))
    after[breaks[breaks > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    enough = ends - starts >= least
    return starts[enough], ends[enough]


def entropy(value: bytes) -> float:
    """Bits a character, from the frequencies in the value itself."""
    _, times = np.unique(np.frombuffer(value, np.uint8), return_counts=True)
    share = times / len(value)
    return float(-(share * np.log2(share)).sum())


def random_looking(value: bytes) -> bool:
    kinds = np.frombuffer(value, np.uint8)
    digit = (kinds >= 48) & (kinds < 58)
    letter = ((kinds | 32) >= 97) & ((kinds | 32) < 123)
    return bool(digit.any() and letter.any()) and entropy(value) >= RUN_BITS


def candidates(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, bytes]]:
    """(row, start byte, kind, end byte, secret), sorted, of the texts in some bytes."""
    whole, found = data.tobytes(), []
    # An assignment needs one of two signs, an access key its four letters.
    signs = np.flatnonzero((data == ord("=")) | (data == ord(":")))
    for row in np.unique(np.searchsorted(offsets, signs, side="right") - 1):
        for m in ASSIGN.finditer(whole, int(offsets[row]), int(offsets[row + 1])):
            if len(m[2]) >= ASSIGN_LEAST:
                found.append((int(row), m.start(), 0, m.end(), m[2]))
    at = whole.find(b"AKIA")
    while at >= 0:
        row = int(np.searchsorted(offsets, at, side="right")) - 1
        # The four letters may begin in one text and end in the next; the pattern stays in one.
        for m in ACCESS.finditer(whole, at, int(offsets[row + 1])):
            if m.end() - m.start() >= ACCESS_LEAST:
                found.append((row, m.start(), 1, m.end(), m[0]))
        at = whole.find(b"AKIA", int(offsets[row + 1]))
    starts, ends = long_runs(data, offsets, HEX, HEX_LEAST)
    of = np.searchsorted(offsets, starts, side="right") - 1
    found += [(int(r), int(a), 2, int(b), whole[a:b]) for r, a, b in zip(of, starts, ends)]
    base: dict[int, list[tuple[int, int]]] = {}
    for row, a, _, b, _ in found:
        base.setdefault(row, []).append((a, b))
    starts, ends = long_runs(data, offsets, RUN, RUN_LEAST)
    of = np.searchsorted(offsets, starts, side="right") - 1
    for r, a, b in zip(of, starts, ends):
        if random_looking(whole[a:b]) and not any(a < y and x < b for x, y in base.get(int(r), ())):
            found.append((int(r), int(a), 3, int(b), whole[a:b]))
    return sorted(found)


def span_list(spans: list[tuple[int, int, int]]) -> str:
    """``kind:start:end`` of (start, kind, end), joined."""
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scan(batch: pa.RecordBatch, text: str) -> dict[str, pa.Array]:
    data, offsets = texts.raw(batch.column(batch.schema.get_field_index(text)))
    found = candidates(data, offsets)
    points = None
    if found and (data >= 128).any():
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    by_row: list[list] = [[] for _ in range(batch.num_rows)]
    for row, start, kind, end, secret in found:
        low = int(offsets[row])
        if points is not None:
            start, end, low = int(points[start]), int(points[end]), int(points[low])
        by_row[row].append((start - low, kind, end - low, hashlib.sha256(secret).digest()[:16]))
    counts = [[sum(s[1] == k for s in spans) for spans in by_row] for k in range(BASE_KINDS)]
    base = [span_list([s[:3] for s in spans if s[1] < BASE_KINDS]) for spans in by_row]
    at = np.cumsum([0, *map(len, by_row)]).astype(np.int32)
    flat = [s for spans in by_row for s in spans]
    parts = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    structs = pa.StructArray.from_arrays(
        [pa.array([s[i] for s in flat], kind) for i, kind in enumerate(parts)], names=["start", "kind", "end", "secret"]
    )
    return {
        **{name: pa.array(values, pa.int64()) for name, values in zip(OUTPUTS, counts)},
        "base_sha256": pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
        "found": pa.ListArray.from_arrays(pa.array(at), structs),
    }


def ownership(values: DataFrame) -> DataFrame:
    """(secret, uses, repositories, owners) of a table (secret, owner, repository).

    Every step merges in the tasks first, so a value that stands in a third of all rows is a
    row per task, and no group is ever collected. A repository belongs to its
    owner; a missing owner counts as one owner, a missing repository as one of its owner.
    """
    by_repository = values.groupBy("secret", "owner", "repository").agg(F.count("*").alias("uses"))
    by_owner = by_repository.groupBy("secret", "owner").agg(F.sum("uses").alias("uses"), F.count("*").alias("repositories"))
    return by_owner.groupBy("secret").agg(
        F.sum("uses").alias("uses"), F.sum("repositories").alias("repositories"), F.count("*").alias("owners")
    )


def _joined(spans: Column) -> Column:
    """``kind:start:end`` of structs (start, kind, end), by start, then kind."""

    def one(span: Column) -> Column:
        kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), span["kind"] + 1)
        return F.concat_ws(":", kind, span["start"].cast("string"), span["end"].cast("string"))

    return F.array_join(F.transform(F.array_sort(spans), one), ",")


@shielded("text", "owner", "repository", outputs=OUTPUTS)
def secret_scan(
    df: DataFrame,
    text: str = "text",
    owner: str = "source",
    repository: str = "doc_id",
    carry: list[str] | None = None,
    most_owners: int = MOST_OWNERS,
) -> DataFrame:
    """Find credentials in every text and tell live ones from copied examples.

    Returns the ``carry`` columns (all by default) with ``n_assign``, ``n_access`` and
    ``n_hex`` (spans of the three patterns), ``base_sha256`` of their list
    (``kind:start:end`` by start, then kind, comma-joined; code points, end
    exclusive), ``spans`` (these, and the ``run`` spans that are live),
    ``live_spans``, ``n_live`` and ``n_copied`` (spans of any kind, runs included, whose
    value has at most and more than ``most_owners`` distinct owners in the corpus).

    The value of an assignment is what is assigned, of other kinds the whole span. A
    run is a string of 20 or more of ``A-Za-z0-9+/_-`` with a letter, a digit and 3
    bits of entropy a character, outside the other spans. A null text counts as empty
    and has no spans. Repeated rows each have their spans, and are one repository. A
    missing owner counts as one owner. An empty table gives no rows. Columns of any name
    are carried; those of the outputs' names are replaced. The carried
    columns and the spans are stored once in the shared checkpoint folder.
    """
    rows = df.select(*carry, F.col(text).alias("text"), F.col(owner).alias("owner"), F.col(repository).alias("repository"))
    added = {"n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "found": FOUND}

    def scan(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return _scan(batch, "text")

    scanned = texts.map_batches(rows, added, scan, "text", drop=("text",))
    scanned = store(scanned.withColumn("row", F.monotonically_increasing_id()))
    spans = scanned.where(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("span"))
    values = spans.select(F.col("span.secret").alias("secret"), "owner", "repository")
    counted = store(ownership(values))
    total = counted.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    keyed = spans.select("row", F.col("span.secret").alias("secret"), "span.start", "span.kind", "span.end")
    judged = join_counted(keyed, counted, ["secret"], "uses", total)
    live = F.col("owners") <= most_owners
    span = F.struct("start", "kind", "end")
    # A group is the spans of one text.
    of_row = judged.groupBy("row").agg(
        F.collect_list(F.when(live | (F.col("kind") < BASE_KINDS), span)).alias("all"),
        F.collect_list(F.when(live, span)).alias("live"),
        F.count(F.when(live, 1)).alias("n_live"),
        F.count(F.when(~live, 1)).alias("n_copied"),
    )
    listed = of_row.select("row", _joined(F.col("all")).alias("spans"), _joined(F.col("live")).alias("live_spans"), "n_live", "n_copied")
    return scanned.join(listed, "row", "left").select(
        *carry, *OUTPUTS[:4], F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("live_spans", F.lit("")).alias("live_spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )
