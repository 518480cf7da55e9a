"""Sharding: a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightlag.llm.common import read_table, store, utf8_length

#: Cells of the ring. Keys and virtual nodes fall into cells; what is planned is one number per cell.
CELLS = 1 << 14
VIRTUAL_NODES = 64
#: Copies of one row are unfolded in chunks of this size.
COPIES_AT_ONCE = 10_000
OVERHEAD_BYTES = 16


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise. Adding a shard adds nodes and moves none."""
    nodes = []
    for shard in range(shards):
        for copy in range(virtual_nodes):
            digest = hashlib.blake2b(f"{shard}:{copy}".encode(), digest_size=8).digest()
            nodes.append((int.from_bytes(digest, "big"), shard))
    return [(position % cells, shard) for position, shard in sorted(nodes, key=lambda n: (n[0] % cells, n))]


def place(
    counts: Sequence[int], capacity: Sequence[int], nodes: Sequence[tuple[int, int]]
) -> list[tuple[int, int, int, int, int]]:
    """Where the rows of each cell go: (cell, first rank, end rank, shard, first slot).

    A shard first takes the rows of its own arcs, clockwise from cell 0, up to its
    capacity. What is left of a cell goes on clockwise to the next virtual node
    whose shard has room, and so on. One number per cell goes in, so the work is
    bounded by cells and virtual nodes, whatever the number of rows.
    """
    cells_of_nodes = [cell for cell, _ in nodes]
    room, slots = list(capacity), [0] * len(capacity)
    placed, waiting = [], []

    def take(cell: int, rank: int, n: int, shard: int) -> int:
        n = min(n, room[shard])
        if n:
            placed.append((cell, rank, rank + n, shard, slots[shard]))
            room[shard] -= n
            slots[shard] += n
        return n

    for cell, n in enumerate(counts):
        home = bisect.bisect_left(cells_of_nodes, cell) % len(nodes)
        taken = take(cell, 0, n, nodes[home][1]) if n else 0
        if taken < n:
            waiting.append((cell, taken, n, home))
    # From each node, the next one clockwise that may still have room; paths are shortened as they are walked.
    onward = list(range(1, len(nodes))) + [0]
    for cell, rank, n, home in waiting:
        walked, node = [], onward[home]
        while rank < n:
            if room[nodes[node][1]] == 0:
                walked.append(node)
                node = onward[node]
                continue
            rank += take(cell, rank, n - rank, nodes[node][1])
        for full in walked:
            onward[full] = node
    return placed


def assign_shards(rows: DataFrame, key: str, shards: int, slack: float = 0.0, cells: int = CELLS) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``; existing columns of these names give way.

    Without slack the counts of shards differ by one at most. With slack a shard may
    hold up to ``1 + slack`` of an even share and fewer rows leave their home shard.
    Slots number the rows of a shard from 0 without gaps.

    Rows are placed by the hash of ``key`` (null is a key like others). Within a cell
    they are ranked by all their columns, so the result is the same in every run;
    rows equal in all columns are counted before the shuffle and unfolded after it,
    so a row with very many copies is no large group. All columns must be sortable
    and should be narrow: carry ids and sizes, not texts. An empty table stays empty.
    Other columns may have any name, as they are numbered while rows are placed.
    """
    kept = {f"c{i}": c for i, c in enumerate(rows.columns) if c not in ("shard", "slot")}
    columns, key = list(kept), f"c{rows.columns.index(key)}"
    rows = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    cell = F.pmod(F.xxhash64(F.lit("cell"), F.col(key)), F.lit(cells)).cast("int").alias("_cell")
    hashed = F.xxhash64(F.lit("rank"), F.col(key)).alias("_hash")
    distinct = store(
        rows.select(cell, hashed, *columns).groupBy("_cell", "_hash", *columns).agg(F.count("*").alias("_copies")),
        "ring-rows",
    )
    # One row per cell: bounded by ``cells``.
    per_cell = {r["_cell"]: r["n"] for r in distinct.groupBy("_cell").agg(F.sum("_copies").alias("n")).collect()}
    total = sum(per_cell.values())
    if slack > 0:
        most = -(-total * (1 + slack) // shards)
        capacity = [int(most)] * shards
    else:
        capacity = [total // shards + (shard < total % shards) for shard in range(shards)]
    plan = place([per_cell.get(c, 0) for c in range(cells)], capacity, ring(shards, cells=cells))

    in_cell = Window.partitionBy("_cell").orderBy("_hash", *columns).rowsBetween(Window.unboundedPreceding, -1)
    ranked = distinct.withColumn("_first", F.coalesce(F.sum("_copies").over(in_cell), F.lit(0)))
    chunks = ranked.withColumn(
        "_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(COPIES_AT_ONCE).cast("long")))
    )
    last = F.least(F.col("_from") + COPIES_AT_ONCE, F.col("_copies")) - 1
    one_each = chunks.withColumn("_nth", F.explode(F.sequence(F.col("_from"), last))).withColumn(
        "_rank", F.col("_first") + F.col("_nth")
    )
    # At most one interval per cell and one more per time a shard fills up.
    schema = "_cell int, _begin long, _end long, shard int, _slot long"
    intervals = rows.sparkSession.createDataFrame(plan, schema)
    inside = (F.col("_rank") >= F.col("_begin")) & (F.col("_rank") < F.col("_end"))
    found = one_each.join(F.broadcast(intervals), (one_each["_cell"] == intervals["_cell"]) & inside)
    back = [F.col(c).alias(name) for c, name in kept.items()]
    return found.select(*back, "shard", (F.col("_slot") + F.col("_rank") - F.col("_begin")).alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        (utf8_length(F.col("text")) + OVERHEAD_BYTES).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return assign_shards(docs, "doc_id", 40).select(
        "*", F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    )
