"""Resharding by minimum-cost flow.

The sizes of the old shards are supplies and the capacities of the new ones are
demands. A minimum-cost flow between them, on a graph of shards alone, says how
many bytes of which shard go where so that the fewest bytes move; every old shard
is then cut into blocks of whole rows along that solution.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F

from wavebook.llm.common import fresh, literal_shards, materialise, running_total, shielded

# Bytes a row takes besides its text.
ROW_BYTES = 16

# A row above this share of a shard is placed before the others of its shard, so
# that shards are cut between small rows.
LARGE_SHARE = 1 / 200

OUTPUTS = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[float]]) -> list[list[int]]:
    """Units to send from each supply to each demand at the least total cost.

    Successive shortest paths with potentials, on as many nodes as there are
    shards. ``supply`` and ``demand`` must have the same sum.
    """
    n, m = len(supply), len(demand)
    left, need = list(supply), list(demand)
    flow = [[0] * m for _ in range(n)]
    height = [0.0] * (n + m)
    low = min((c for row in cost for c in row), default=0.0)
    if low < 0:
        raise ValueError("costs must not be negative")
    while any(left):
        distance = [0.0 if i < n and left[i] else float("inf") for i in range(n + m)]
        before = [-1] * (n + m)
        queue = [(0.0, i) for i in range(n) if left[i]]
        done = [False] * (n + m)
        while queue:
            d, v = heapq.heappop(queue)
            if done[v]:
                continue
            done[v] = True
            if v < n:
                steps = [(n + j, cost[v][j]) for j in range(m)]
            else:
                steps = [(i, -cost[i][v - n]) for i in range(n) if flow[i][v - n]]
            for w, price in steps:
                further = d + max(0.0, price + height[v] - height[w])
                if further < distance[w]:
                    distance[w], before[w] = further, v
                    heapq.heappush(queue, (further, w))
        end = min((j for j in range(m) if need[j]), key=lambda j: (distance[n + j] + height[n + j], j))
        reach = distance[n + end]
        path = [n + end]
        while before[path[-1]] >= 0:
            path.append(before[path[-1]])
        path.reverse()
        back = [flow[w][v - n] for v, w in zip(path, path[1:]) if v >= n]
        units = min([left[path[0]], need[end], *back])
        for v, w in zip(path, path[1:]):
            if v < n:
                flow[v][w - n] += units
            else:
                flow[w][v - n] -= units
        left[path[0]] -= units
        need[end] -= units
        height = [h + min(d, reach) for h, d in zip(height, distance)]
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    """Whole sizes that differ by one at most."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def transfers(old_sizes: dict[int, int], capacities: list[int], cost=None) -> list[tuple[int, int, int, int]]:
    """(old, new, from byte, to byte): the blocks of each old shard and where they go.

    What stays in a shard comes first. By default a byte that stays costs nothing
    and one that moves costs 1; ``cost(old, new)`` may say otherwise.
    """
    price = cost or (lambda old, new: 0.0 if old == new else 1.0)
    olds = sorted(old_sizes)
    flow = min_cost_flow(
        [old_sizes[o] for o in olds], capacities, [[price(o, j) for j in range(len(capacities))] for o in olds]
    )
    blocks = []
    for old, row in zip(olds, flow):
        at = 0
        for new in sorted((j for j, units in enumerate(row) if units), key=lambda j: (j != old, j)):
            blocks.append((old, new, at, at + row[new]))
            at += row[new]
    return blocks


@shielded("old_shard", "text", "id_column", outputs=[*OUTPUTS, "old_shard"])
def reshard(
    df: DataFrame,
    shards: int,
    old_shard: str,
    text: str = "text",
    id_column: str = "doc_id",
    carry: list[str] | None = None,
    cost=None,
) -> DataFrame:
    """Place every row in one of ``shards`` shards of nearly equal bytes.

    ``old_shard`` is a column with the shard, a whole number, that a row is in now.
    Returns the ``carry`` columns (all by default) and ``size`` (UTF-8 bytes of the
    text and 16), ``text_crc32`` of the text's bytes, ``law`` (``bytes``),
    ``old_shard``, ``shard``, ``slot`` (gapless from 0 in a shard) and a null
    ``grown_shard``. Of all placements with these capacities it moves the fewest
    bytes, up to the rows at the cuts.

    A null text has no bytes and the crc32 of none; a row with a null old shard is
    in no shard yet and always moves. Equal rows are placed one after the other.
    An empty table gives no rows. Columns of any name are carried; those of the outputs'
    names are replaced. Rows are ordered by a digest of id and text, large ones first; the
    totals are taken in slices, so an old shard of any size is no single task.
    """
    digest, start, large, place = fresh(df, "_digest", "_start", "_large", "_place")
    whole = F.coalesce(F.col(text), F.lit(""))
    sized = materialise(
        df.select(
            *[F.col(f"`{c}`") for c in carry],
            F.coalesce(F.col(old_shard).cast("int"), F.lit(-1)).alias("old_shard"),
            (F.octet_length(whole) + ROW_BYTES).cast("bigint").alias("size"),
            F.crc32(whole.cast("binary")).alias("text_crc32"),
            F.xxhash64(id_column, text).alias(digest),
        )
    )
    # One row per old shard.
    sizes = {r.old_shard: r.n for r in sized.groupBy("old_shard").agg(F.sum("size").alias("n")).collect()}
    total = sum(sizes.values())
    blocks = transfers(sizes, even_capacities(total, shards), cost)
    sized = sized.withColumn(large, F.col("size") > F.lit(total / shards * LARGE_SHARE))
    # Large rows take the front of the order, the rest follow by digest.
    unit = F.pmod(F.col(digest), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
    fraction = F.when(F.col(large), F.lit(0.0)).otherwise((unit * 4095 + 1) / 4096)
    order = [F.col(large).desc(), F.when(F.col(large), -F.col("size")), unit, F.col(digest), F.col("size")]
    placed = running_total(sized, ["old_shard"], order, F.col("size"), start, fraction)
    cut = literal_shards(df.sparkSession, blocks)
    middle = F.expr(f"{start} + size div 2")
    moved = placed.join(F.broadcast(cut), "old_shard").where(
        (middle >= F.col("low")) & (middle < F.col("high"))
    ).drop("low", "high")
    # Slots count rows of a shard in the order of old shards and digests.
    numbered = running_total(
        moved.withColumn(place, F.lit(1).cast("bigint")), ["shard"],
        [unit, F.col(digest), F.col("old_shard"), F.col("size")], F.col(place), "slot", unit,
    )
    return numbered.select(
        *carry, "size", "text_crc32", F.lit("bytes").alias("law"), "old_shard", "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def affected_shards(placed: DataFrame) -> list[int]:
    """Shards that lose or gain rows: the only ones whose files must be rewritten."""
    moved = placed.where("old_shard != shard")
    rows = moved.select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct().collect()
    return sorted(r.shard for r in rows)


def rewrite(placed: DataFrame, folder: str) -> list[int]:
    """Write the files of the affected shards below ``folder`` (``shard=7/part-...``).

    Files of shards that neither lose nor gain a row are left as they are. The
    rows written are spread over tasks by shard and slot range, so that a large
    shard is several files. Returns the shards written.
    """
    affected = affected_shards(placed)
    changed = placed.where(F.col("shard").isin(affected))
    (
        changed.repartition("shard", F.expr("slot div 1000000"))
        .sortWithinPartitions("shard", "slot")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("shard").parquet(folder)
    )
    return affected
