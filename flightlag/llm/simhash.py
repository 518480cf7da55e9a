"""SimHash near-dedup: fingerprints of word shingles, linked by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightlag.llm.common import bound_batches, read_table, store, unsigned_hex
from flightlag.llm.components import components

BITS = 64
SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Fingerprints a trie node holds on average where the distributed part stops,
#: bits it goes deeper where a node pair has more than MOST of them.
NODE_SIZE, MOST, DEEPER = 512, 50_000, 6
#: Node pairs and links a task holds at once.
PAIRS_AT_ONCE = 1 << 20
ROWS_AT_ONCE = 200_000


# ------------------------------------------------------------------ fingerprints


def simhash(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """A bit is set if it is set in over half the XXH64 of all shingles; no words give 0."""
    import xxhash

    words = text.encode().lower().split() if text else []
    n = max(1, len(words) - shingle_words + 1)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first = starts[:n].tolist()
    last = ends[min(shingle_words, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(BITS, np.int64)
    for low in range(0, n, 1 << 16):
        digests = b"".join([digest(joined[a:b], SEED) for a, b in zip(first[low : low + (1 << 16)], last[low : low + (1 << 16)])])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


@F.arrow_udf(T.LongType())
def fingerprint(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        values = np.array([simhash(t.as_py()) for t in batch], np.uint64)
        yield pa.array(values.view(np.int64), pa.int64())


# ----------------------------------------------------- the trie join within a task


def star_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as keep the components of links (a, b): each node to its least one."""
    if not len(a):
        return a, b
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = inverse[: len(a)], inverse[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        pa_, pb = parent[a], parent[b]
        if (pa_ == pb).all():
            break
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while (parent != parent[parent]).any():
            parent = parent[parent]
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


class TrieJoin:
    """Walks pairs of nodes of binary tries down together.

    Values are sorted; a node is a range of them that shares its first ``depth``
    bits. A pair of nodes carries the bits in which they differ so far and is
    dropped once these exceed ``budget(depth)``. Two leaves are compared at once.
    """

    def __init__(self, values: np.ndarray, budget: list[int]):
        self.values, self.budget = values, budget
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.held = 0

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(self.values[a])
        self.b.append(self.values[b])
        self.held += len(a)
        if self.held > 4 * PAIRS_AT_ONCE:
            self._reduce()

    def _reduce(self) -> None:
        a, b = star_links(np.concatenate(self.a), np.concatenate(self.b))
        self.a, self.b, self.held = [a], [b], len(a)

    def run(self, depth: int, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``pairs`` has rows (left from, left to, right from, right to, differing bits)."""
        waiting = [(depth, pairs)]
        while waiting:
            depth, pairs = waiting.pop()
            if len(pairs) > PAIRS_AT_ONCE:
                half = len(pairs) // 2
                waiting += [(depth, pairs[:half]), (depth, pairs[half:])]
                continue
            below = self._down(depth, self._leaves(pairs))
            if len(below):
                waiting.append((depth + 1, below))
        if not self.a:
            none = np.zeros(0, np.uint64)
            return none, none
        self._reduce()
        return self.a[0], self.b[0]

    def _leaves(self, pairs: np.ndarray) -> np.ndarray:
        own = pairs[:, 0] == pairs[:, 2]
        single = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
        met = pairs[single & ~own]
        if len(met):
            near = np.bitwise_count(self.values[met[:, 0]] ^ self.values[met[:, 2]]) <= self.budget[BITS]
            self._link(met[near, 0], met[near, 2])
        return pairs[~single]

    def _down(self, depth: int, pairs: np.ndarray) -> np.ndarray:
        if not len(pairs):
            return pairs
        if depth == BITS:  # only for values that are not distinct
            self._link(pairs[:, 0], pairs[:, 2])
            return pairs[:0]
        set_before = np.concatenate([[0], np.cumsum((self.values >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int64)])
        l0, l2, r0, r2, e = pairs.T
        l1, r1 = l2 - (set_before[l2] - set_before[l0]), r2 - (set_before[r2] - set_before[r0])
        own = l0 == r0
        below = [
            np.stack([l0, l1, r0, r1, e], 1),
            np.stack([l1, l2, r1, r2, e], 1),
            np.stack([l0, l1, r1, r2, e + 1], 1),
            np.stack([l1, l2, r0, r1, e + 1], 1)[~own],
        ]
        pairs = np.concatenate(below)
        kept = (pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (pairs[:, 4] <= self.budget[depth + 1])
        return pairs[kept]


def _budget(first_half: int, total: int) -> list[int]:
    """Differing bits allowed down to each depth."""
    return [first_half if depth <= BITS // 2 else total for depth in range(BITS + 1)]


def _join_pairs(depth: int, budgets: dict[int, list[int]]):
    """Rows sorted by (turned, p, q, side, value) to links; whole node pairs at a time."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("turned", "p", "q", "differ", "side", "value")])
            size += batch.num_rows
            if size >= ROWS_AT_ONCE:
                whole = [np.concatenate(c) for c in zip(*held)]
                key = np.stack(whole[:3])
                last = int(np.flatnonzero((key != key[:, -1:]).any(0))[-1]) + 1 if (key != key[:, -1:]).any() else 0
                if last:
                    yield [c[:last] for c in whole]
                held, size = [[c[last:] for c in whole]], len(whole[0]) - last
        if size:
            yield [np.concatenate(c) for c in zip(*held)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turned, p, q, differ, side, value in chunks(batches):
            value = value.view(np.uint64)
            for turn, budget in budgets.items():
                mine = np.flatnonzero(turned == turn)
                if not len(mine):
                    continue
                v, kp, kq, ks, kd = value[mine], p[mine], q[mine], side[mine], differ[mine]
                new = np.concatenate([[True], (kp[1:] != kp[:-1]) | (kq[1:] != kq[:-1])])
                start = np.flatnonzero(new)
                end = np.append(start[1:], len(v))
                middle = start + np.add.reduceat((ks == 0).astype(np.int64), start)
                own = kp[start] == kq[start]
                pairs = np.stack([start, np.where(own, end, middle), np.where(own, start, middle), end, kd[start]], 1).astype(np.int64)
                # A pair of nodes of which one is empty has nothing to join.
                pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])]
                # Values of one side are sorted as signed numbers; the trie needs them unsigned.
                order = np.lexsort((v, ks, np.cumsum(new)))
                a, b = TrieJoin(v[order], budget).run(depth, pairs)
                if turn:
                    a, b = (x << np.uint64(32) | x >> np.uint64(32) for x in (a, b))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

    return run


# ------------------------------------------------------------ the trie join in Spark


def _descend(pairs: DataFrame, depth: int, bits: int, budgets: dict[int, list[int]]) -> DataFrame:
    """Each row to the node pairs ``bits`` deeper that hold it and are within budget."""
    here = F.call_function("shiftrightunsigned", F.col("value"), F.lit(BITS - depth - bits)).bitwiseAND((1 << bits) - 1)
    masks = [(sum(1 << b for b in c), k) for k in range(MAX_BITS + 1) for c in combinations(range(bits), k)]
    most = max(budget[depth + bits] for budget in budgets.values())
    listed = F.array(*[F.struct(F.lit(m).cast("long").alias("flip"), F.lit(k).alias("more")) for m, k in masks if k <= most])
    allowed = F.lit(-1)
    for turn, budget in budgets.items():
        allowed = F.when(F.col("turned") == turn, F.lit(budget[depth + bits])).otherwise(allowed)
    own = F.when(F.col("side") == 0, F.col("p")).otherwise(F.col("q"))
    other = F.when(F.col("side") == 0, F.col("q")).otherwise(F.col("p"))
    low = pairs.withColumns({"here": here, "own": own, "other": other, "step": F.explode(listed)}).where(
        F.col("differ") + F.col("step.more") <= allowed
    )
    low = low.withColumns(
        {
            "own": F.shiftleft("own", bits).bitwiseOR(F.col("here")),
            "other": F.shiftleft("other", bits).bitwiseOR(F.col("here").bitwiseXOR(F.col("step.flip"))),
        }
    )
    p = F.least("own", "other")
    return low.select(
        "turned",
        p.alias("p"),
        F.greatest("own", "other").alias("q"),
        (F.col("differ") + F.col("step.more")).alias("differ"),
        (F.col("own") != p).cast("int").alias("side"),
        "value",
    )


def near_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v) with the components of all pairs of ``value`` at most ``max_bits`` apart.

    ``prints`` has distinct longs ``value``. Pairs with at most half the budget in
    their first 32 bits are found in a trie over the values, the others have few in
    their last 32 bits and are found in a trie over the values turned by 32 bits, so
    node pairs are pruned early. The upper levels are walked in Spark: each value is
    sent to the node pairs within budget that hold it. Node pairs with more than MOST
    values go down further in the same way, so no task gets a dense part of the
    trie whole. Below, a task walks whole node pairs and returns at most one link
    per value and node pair, not all pairs.
    """
    if max_bits > MAX_BITS:
        raise ValueError(f"at most {MAX_BITS} bits")
    half = max_bits // 2
    budgets = {0: _budget(half, max_bits)}
    if max_bits - half - 1 >= 0:
        budgets[1] = _budget(max_bits - half - 1, max_bits)
    n = prints.count()
    depth = max(2, min(24, round(log2(max(1, n / NODE_SIZE)))))
    turned = F.explode(F.array(*[F.lit(t) for t in budgets]))
    swapped = F.shiftleft("value", 32).bitwiseOR(F.call_function("shiftrightunsigned", F.col("value"), F.lit(32)))
    rows = prints.withColumn("turned", turned).select(
        "turned",
        *[F.lit(0).cast(kind).alias(c) for c, kind in (("p", "long"), ("q", "long"), ("differ", "int"), ("side", "int"))],
        F.when(F.col("turned") == 0, F.col("value")).otherwise(swapped).alias("value"),
    )
    rows = _descend(rows, 0, depth, budgets)
    key = ["turned", "p", "q"]
    found = []
    while True:
        rows = store(rows, "node-pairs")
        crowded = store(rows.groupBy(*key).count().where(F.col("count") > MOST).select(*key), "crowded-pairs")
        deeper = min(DEEPER, BITS - depth)
        dense = deeper > 0 and not crowded.isEmpty()
        ready = rows.join(crowded, key, "left_anti") if dense else rows
        dealt = ready.repartition(*key).sortWithinPartitions(*key, "side", "value")
        found.append(dealt.mapInArrow(_join_pairs(depth, budgets), "u long, v long"))
        if not dense:
            break
        rows = _descend(rows.join(crowded, key, "left_semi"), depth, deeper, budgets)
        depth += deeper
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints at most ``max_bits`` apart are linked; ``component_id`` is the
    smallest id that links lead to, the row's own included. Null and empty texts
    have fingerprint 0 and are linked like others. Rows without an id belong to a
    component but do not name it; one of such rows only has a null name. Rows that
    repeat stay as they are. An empty table gives no rows.

    Equal fingerprints are one value in all that follows, so a large group of copies
    costs one value; the joins back to rows are split by adaptive execution.
    """
    bound_batches(docs.sparkSession)
    prints = store(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text)).alias("value")), "fingerprints")
    values = store(prints.groupBy("value").agg(F.min("doc_id").alias("least")), "values")
    links = store(near_links(values.select("value"), max_bits), "links")
    roots = components(links)
    v, r = values.alias("v"), roots.alias("r")
    rooted = store(
        v.join(r, F.col("v.value") == F.col("r.u"), "left").select(
            "v.value", "v.least", F.coalesce("r.root", "v.value").alias("root")
        ),
        "rooted",
    )
    names = store(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names").alias("n")
    named = store(
        rooted.alias("v").join(names, F.col("v.root") == F.col("n.root")).select("v.value", "n.component_id"), "named"
    )
    return (
        prints.alias("p")
        .join(named.alias("n"), F.col("p.value") == F.col("n.value"))
        .select(F.col("p.doc_id").alias(id_col), unsigned_hex(F.col("p.value")).alias("fingerprint"), "n.component_id")
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents"))
