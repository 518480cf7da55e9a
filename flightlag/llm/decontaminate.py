"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightlag.llm.common import bound_batches, flat_text, lower_ascii, pieces, read_table, store

#: Words of a span that must be found wherever it is shared.
SPAN = 13
#: Words of a fingerprinted gram; of each SPAN - GRAM + 1 grams in a row the least hash is kept.
GRAM = 6
WINDOW = SPAN - GRAM + 1
#: Bits of the filter that drops fingerprints no item has; its size does not depend on the data.
FILTER_BITS = 1 << 22
TEXT_AT_ONCE = 1 << 20

_IS_WORD = np.ones(256, bool)
_IS_WORD[:128] = False
_IS_WORD[48:58] = _IS_WORD[97:123] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)

FINGERPRINTS = "array<struct<words:int,fingerprint:long,position:int,before:int,context:string>>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of many texts: where they are, whose they are, and a hash of each."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.raw = lower_ascii(raw)
        n = len(raw)
        inside = _IS_WORD[self.raw]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = at[1:-1]
        before[edges[edges < n]] = False
        after[edges[edges > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, at)
        self.text_of = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        # Prefix sums of a polynomial; a word is the difference of two, moved to power 0.
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
        self.hashes = _mix((sums[self.ends] - sums[self.starts]) * _powers(_BASE_INVERSE, n + 1)[self.starts])

    def __len__(self) -> int:
        return len(self.starts)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each word on, as far as there are so many."""
        m = len(self) - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        out = self.hashes[:m].copy()
        for j in range(1, k):
            out = out * _STEP + self.hashes[j : j + m]
        return _mix(out + np.uint64(k))

    def within(self, k: int) -> np.ndarray:
        """Words from which ``k`` words lie in one text."""
        m = len(self) - k + 1
        return np.flatnonzero(self.text_of[:m] == self.text_of[k - 1 :]) if m > 0 else np.zeros(0, np.int64)

    def winnowed(self) -> tuple[np.ndarray, np.ndarray]:
        """Words at which a kept gram begins, and its hash: in each SPAN the rightmost least gram."""
        starts = self.within(SPAN)
        grams = self.grams(GRAM)
        if not len(starts):
            return starts, grams[:0]
        least, at = grams[starts], starts.copy()
        for j in range(1, WINDOW):
            other = grams[starts + j]
            closer = other <= least
            least = np.where(closer, other, least)
            at[closer] = starts[closer] + j
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        return at, grams[at]

    def context(self, word: int, left: int, right: int) -> tuple[int, str]:
        """Words around, at most ``left`` before and up to ``right`` from ``word`` on, within the text."""
        text = self.text_of[word]
        a, b = max(word - left, self.first[text]), min(word + right, self.first[text + 1])
        parts = [self.raw[s:e].tobytes() for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]
        return int(word - a), b" ".join(parts).decode("utf-8", "replace")


def _fingerprints(words: Words, short: tuple[int, ...], allowed: np.ndarray | None, items: bool) -> list[list[dict]]:
    """Fingerprints of each text: kept grams of SPANs, and all grams of the lengths in ``short``.

    With ``items`` a text of fewer than SPAN words gives its whole sequence only.
    """
    out: list[list[dict]] = [[] for _ in range(len(words.first) - 1)]
    counts = np.diff(words.first)
    found = [(SPAN, *words.winnowed())]
    for k in short:
        at = words.within(k)
        if items:
            at = at[counts[words.text_of[at]] == k]
        found.append((k, at, words.grams(k)[at]))
    for k, at, prints in found:
        if allowed is not None and len(at):
            slot = (prints & np.uint64(FILTER_BITS - 1)).astype(np.int64)
            passed = (allowed[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
            at, prints = at[passed], prints[passed]
        for word, fingerprint in zip(at.tolist(), prints.view(np.int64).tolist()):
            left, right = (WINDOW - 1, GRAM + WINDOW - 1) if k == SPAN else (0, k)
            before, context = words.context(word, left, right)
            text = int(words.text_of[word])
            position = word - int(words.first[text])
            out[text].append(
                {"words": k, "fingerprint": fingerprint, "position": position, "before": before, "context": context}
            )
    return out


def _scan(short: tuple[int, ...], allowed: np.ndarray | None, items: bool):
    prints = pa.list_(
        pa.struct(
            [("words", pa.int32()), ("fingerprint", pa.int64()), ("position", pa.int32()), ("before", pa.int32()), ("context", pa.string())]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", TEXT_AT_ONCE):
            words = Words(*flat_text(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("text_hash"),
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array(_fingerprints(words, short, allowed, items), prints),
                ],
                names=["id", "text_hash", "n_words", "prints"],
            )

    return run


def _matched(before: list[str], here: list[str], own: int, other: int) -> tuple[int, int]:
    """How many words match to the left of the gram and from its start on."""
    left = 0
    while left < min(own, other) and before[own - 1 - left] == here[other - 1 - left]:
        left += 1
    right = 0
    while right < min(len(before) - own, len(here) - other) and before[own + right] == here[other + right]:
        right += 1
    return left, right


@F.arrow_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
def extend(words: pa.Array, position: pa.Array, own: pa.Array, text: pa.Array, other: pa.Array, item: pa.Array) -> pa.Array:
    """Words [start, stop) of the document that match around a shared fingerprint, null if too few."""
    out = []
    for k, at, a, x, b, y in zip(*[c.to_pylist() for c in (words, position, own, text, other, item)]):
        left, right = _matched(x.split(" "), y.split(" "), a, b)
        out.append({"start": at - left, "stop": at + right} if left + right >= k else None)
    return pa.array(out, pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


# Else the filter on its result runs it a second time, in a second worker of the same task.
extend = extend.asNondeterministic()


def covered(spans: Column) -> Column:
    """Number of positions in a union of spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))

    def step(acc: Column, span: Column) -> Column:
        fresh = F.greatest(F.lit(0), span["stop"] - F.greatest(span["start"], acc["end"]))
        return F.struct(F.greatest(acc["end"], span["stop"]).alias("end"), (acc["sum"] + fresh).alias("sum"))

    return F.aggregate(F.sort_array(spans), start, step, lambda acc: acc["sum"])


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document: (``id_col``, n_words, n_hit, n_items, item_ids, text_hash).

    A window is SPAN words in a row of an item, or all words of a shorter item; the
    words of every occurrence of a window are hit. ``item_ids`` are the items with
    occurring windows, as sorted strings.

    Any SPAN shared by a document and an item holds the same least gram in both, so
    both keep it as a fingerprint; shorter items have a fingerprint of all their
    words. Documents drop fingerprints by a filter of fixed size, which never drops
    one an item has, and carry the words around the others; the join on fingerprints
    is then extended word by word, so a hash that meets by chance adds nothing. A
    passage that very many documents hold is a hot fingerprint; the join is one of
    two shuffled sides and is split by adaptive execution.

    Null and empty texts and items have no words. Rows that repeat an id are judged
    each by its own text, items that repeat one count once, items without an id mark
    words but are not counted. Empty tables give no rows, or no hits.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    scanned = f"id {kind}, text_hash long, n_words long, prints {FINGERPRINTS}"
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    item_kind = benchmark.schema[item_id].dataType.simpleString()
    items = benchmark.select(F.col(item_id).alias("id"), F.lit(0).cast("long").alias("text_hash"), F.col(item_text).alias("text"))
    item_scan = f"id {item_kind}, text_hash long, n_words long, prints {FINGERPRINTS}"
    known = store(
        items.mapInArrow(_scan(tuple(range(1, SPAN)), None, True), item_scan).select(
            F.col("id").cast("string").alias("item"), F.explode("prints").alias("p")
        ).select("item", "p.words", "p.fingerprint", F.col("p.before").alias("item_before"), F.col("p.context").alias("item_context")).distinct(),
        "item-prints",
    )
    # At most FILTER_BITS numbers, and SPAN lengths.
    slots = known.select(F.col("fingerprint").bitwiseAND(FILTER_BITS - 1).alias("slot")).distinct()
    used = slots.toPandas()["slot"].to_numpy(np.int64)
    allowed = np.zeros(FILTER_BITS, np.uint8)
    allowed[used] = 1
    allowed = np.packbits(allowed, bitorder="little")
    short = tuple(sorted(r["words"] for r in known.select("words").distinct().collect() if r["words"] < SPAN))

    prints = store(rows.mapInArrow(_scan(short, allowed, False), scanned), "document-prints")
    mine = prints.where(F.size("prints") > 0).select("id", "text_hash", F.explode("prints").alias("p")).select(
        "id", "text_hash", "p.words", "p.fingerprint", "p.position", "p.before", "p.context"
    )
    met = mine.join(known, ["words", "fingerprint"])
    spans = met.select(
        "id", "text_hash", "item", extend("words", "position", "before", "context", "item_before", "item_context").alias("span")
    ).where(F.col("span").isNotNull())
    hits = spans.groupBy("id", "text_hash").agg(
        covered(F.collect_set("span")).alias("n_hit"), F.sort_array(F.collect_set("item")).alias("item_ids")
    )
    d, h = prints.select("id", "text_hash", "n_words").alias("d"), hits.alias("h")
    same = F.col("d.id").eqNullSafe(F.col("h.id")) & (F.col("d.text_hash") == F.col("h.text_hash"))
    none = F.array().cast("array<string>")
    return d.join(h, same, "left").select(
        F.col("d.id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.col("d.text_hash").alias("text_hash"),
    )


def is_contaminated() -> Column:
    """At least one word hit, and one in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2),
         lambda i: array_to_string(w[i : i + least(13, len(w)) - 1], ' '))) AS win
  FROM b WHERE len(w) > 0
), dw AS (
  SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
), met AS (
  SELECT dw.r, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM met)) GROUP BY r
), its AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM met) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
