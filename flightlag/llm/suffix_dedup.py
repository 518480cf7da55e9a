"""Suffix dedup: bytes of repeated long strings, by refining buckets of suffixes.

Bucket-pointer refinement sorts suffixes into buckets by their first q bytes and then
splits buckets by the bucket identifiers found at later offsets; what a round finds
out is reused by the next. Only equality down to ``SIZE`` bytes is asked for here, so
three things differ from a suffix array built on one machine:

* Identifiers are hashes of content, not ranks: every task names a bucket alike without a
  global numbering. They replace the identifiers found at later offsets; a round hashes
  the bytes it compares anew and mixes in the bucket they were in.
* Suffixes enter by the q-gram a window of ``SIZE`` bytes keeps (its least hash),
  which equal windows keep at the same place. About one position in 32 enters and
  stands for the up to ``RANGE`` windows around it.
* A bucket is refined from ``RANGE`` windows at once to 8 and then to single ones. A
  bucket of one suffix is finished and leaves; so do windows whose whole surrounding
  repeats an earlier one.

All texts stand end to end in the order that decides who is earlier, so a suffix has one
number, its place among all bytes, and the earliest of equal ones is a plain minimum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightlag.llm.common import _setting, bound_batches, discard, flat_text, pieces, read_table, store_at, utf8_length
from flightlag.session import scratch_path

#: A repeated string has so many bytes at least; windows a suffix stands for; bytes of the first buckets.
SIZE, RANGE = 100, 64
GRAM = SIZE - RANGE + 1
#: Windows of a part of a range in the second round; the third has single windows.
PART = 8
TEXT_AT_ONCE = 1 << 19
#: A join whose one side has partitions of at most this size, as measured once it is shuffled, hashes that side.
HASHED_SIDE = ("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")

_BASE = 0x9E3779B97F4A7C15
_LAST = (1 << 63) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


class Identifiers:
    """Identifiers of substrings of one buffer, each from two prefix sums."""

    def __init__(self, raw: np.ndarray):
        n = 1 << max(16, int(len(raw) + 1).bit_length())
        self.up, self.down = _powers(n)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return _mix((self.sums[size:] - self.sums[:-size]) * self.down[:n])


def entering(raw: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Suffixes that enter for the windows ``first`` to ``last`` (exclusive) of each text.

    Returns per suffix (text, position, first window, last window, bucket, whole):
    the windows of its range that begin from ``low`` to ``high`` of the text, the
    identifier of its first GRAM bytes, and that of all bytes of these windows.
    """
    ids = Identifiers(raw)
    value = ids.grams(GRAM)
    at = np.arange(len(value), dtype=np.int32)
    step = 1
    while step < RANGE and len(value) > step:
        nearer = value[step:] <= value[:-step]
        value, at = np.where(nearer, value[step:], value[:-step]), np.where(nearer, at[step:], at[:-step])
        step *= 2
    if step < RANGE:
        value, at = value[:0], at[:0]
    counts = np.maximum(last - first, 0)
    text = np.repeat(np.arange(len(first)), counts)
    within = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    window = first[text] + within
    position = at[window].astype(np.int64)
    new = np.ones(len(position), bool)
    new[1:] = (position[1:] != position[:-1]) | (text[1:] != text[:-1])
    text, position = text[new], position[new]
    start, end = np.maximum(low[text], position - RANGE + 1), np.minimum(position, high[text])
    shape = ((position - start) * RANGE + (end - start)).astype(np.uint64)
    bucket = ids.of(position, position + GRAM)
    return text, position, start, end, bucket, _mix(ids.of(start, end + SIZE) + shape)


def _suffixes(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``entering`` over whole texts; very long ones go in overlapping stretches."""
    size = np.diff(at)
    if len(size) > 1 or size[0] <= 2 * TEXT_AT_ONCE:
        yield (*entering(raw, at[:-1], at[1:] - SIZE + 1, at[:-1], at[1:] - SIZE), 0)
        return
    n = int(size[0])
    for begin in range(0, n - SIZE + 1, TEXT_AT_ONCE):
        low, high = max(0, begin - RANGE), min(n, begin + TEXT_AT_ONCE + SIZE + RANGE)
        until = min(begin + TEXT_AT_ONCE, n - SIZE + 1)
        one = [np.array([x - low]) for x in (begin, until, 0 if low == 0 else low, n - SIZE)]
        one[3] = np.minimum(one[3], high - low - SIZE)
        yield (*entering(raw[low:high], *one), low)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (base, text) to suffixes; ``reach`` packs how far before the position its windows begin."""
    for batch in pieces(batches, "text", TEXT_AT_ONCE):
        raw, at = flat_text(batch.column("text"))
        base = batch.column("base").to_numpy(zero_copy_only=False)
        for text, position, start, end, bucket, whole, shift in _suffixes(raw, at):
            if not len(text):
                continue
            reach = ((position - start) << 6) | (position - end)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket.view(np.int64)),
                    pa.array(whole.view(np.int64)),
                    pa.array(base[text]),
                    pa.array(base[text] + position - (at[text] - shift)),
                    pa.array(reach.astype(np.int32)),
                ],
                names=["bucket", "whole", "base", "at", "reach"],
            )


SUFFIX = "bucket long, whole long, base long, at long, reach int"


def _windows(at: Column, reach: Column) -> tuple[Column, Column]:
    """First and last window of a suffix."""
    return at - F.shiftright(reach, 6), at - reach.bitwiseAND(RANGE - 1)


WANTED = T.StructType([T.StructField("at", T.LongType()), T.StructField("reach", T.IntegerType()), T.StructField("bucket", T.LongType())])


@F.arrow_udf(T.ArrayType(T.StructType([*WANTED.fields, T.StructField("bytes", T.BinaryType())])))
def cut_out(texts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The bytes of the windows of each suffix of a text that begins at ``base``."""
    kind = pa.list_(pa.struct([("at", pa.int64()), ("reach", pa.int32()), ("bucket", pa.int64()), ("bytes", pa.binary())]))
    for base, text, wanted in texts:
        out = []
        for b, t, rows in zip(base.to_pylist(), text, wanted):
            raw = t.as_buffer()
            got = []
            for row in rows.as_py():
                position, reach = row["at"] - b, row["reach"]
                start, end = position - (reach >> 6), position - (reach & RANGE - 1)
                got.append({**row, "bytes": raw[start : end + SIZE].to_pybytes()})
            out.append(got)
        yield pa.array(out, kind)


def _refine(size: int):
    """Rows (bucket, base, at, reach, bytes[, parts]) to their windows, ``size`` at a time.

    The new bucket is the old one and the identifier of the bytes all windows of the
    part have in common; ``whole`` is that of all their bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "bytes", TEXT_AT_ONCE):
            raw, offsets = flat_text(batch.column("bytes"))
            reach = batch.column("reach").to_numpy(zero_copy_only=False).astype(np.int64)
            old = batch.column("bucket").to_numpy(zero_copy_only=False).view(np.uint64)
            ids = Identifiers(raw)
            before, after = reach >> 6, reach & RANGE - 1  # windows begin so far before the position
            # Parts are aligned to the position, so equal windows fall into equal parts.
            row, part = np.divmod(np.arange(len(reach) * (RANGE // size)), RANGE // size)
            most, least = np.minimum((part + 1) * size - 1, before[row]), np.maximum(part * size, after[row])
            inside = most >= least
            if "parts" in batch.schema.names:
                inside &= (batch.column("parts").to_numpy(zero_copy_only=False)[row] >> (part * size // PART)) & 1 > 0
            row, part, most, least = row[inside], part[inside], most[inside], least[inside]
            zero = offsets[:-1][row] + before[row]  # where the position is in the buffer
            core = ids.of(zero - part * size, zero - (part + 1) * size + 1 + SIZE)
            shape = ((most - part * size) * RANGE + (least - part * size)).astype(np.uint64)
            whole = _mix(ids.of(zero - most, zero - least + SIZE) + shape)
            # Only equal distances from the position are compared, so its order is that of the windows.
            bucket = _mix(_mix(old[row] + part.astype(np.uint64)) + core)
            arrays = [pa.array(bucket.view(np.int64)), pa.array(whole.view(np.int64))]
            arrays += [pa.array(batch.column(c).to_numpy(zero_copy_only=False)[row]) for c in ("base", "at")]
            arrays += [pa.array(((most << 6) | least).astype(np.int32)), pa.array(old[row].view(np.int64))]
            arrays += [pa.array(part.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "whole", "base", "at", "reach", "root", "part"])

    return run


@F.arrow_udf(
    T.StructType(
        [
            T.StructField("n_removed", T.LongType()),
            T.StructField("n_spans", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
            T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        ]
    )
)
def without(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """What is left of each text without a union of spans of bytes."""
    kind = pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])
    for text, spans in texts:
        out = []
        for t, cuts in zip(text, spans):
            raw = memoryview(t.as_buffer()) if t.is_valid else memoryview(b"")
            runs: list[list[int]] = []
            for c in sorted((c["start"], c["stop"]) for c in cuts.as_py() or ()):
                if runs and c[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], c[1])
                else:
                    runs.append(list(c))
            digest, at = hashlib.sha256(), 0
            for start, stop in runs:
                digest.update(raw[at:start])
                at = stop
            digest.update(raw[at:])
            removed = sum(b - a for a, b in runs)
            out.append({"n_removed": removed, "n_spans": len(runs), "kept_sha256": digest.hexdigest(), "spans": runs})
        yield pa.array(out, kind)


class _Tables:
    """Intermediate tables of one run, each removed as soon as nothing reads it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        with _setting(self.spark, *HASHED_SIDE):
            stored = store_at(df, path)
        self.paths[id(stored)] = path
        return stored

    def drop(self, *stored: DataFrame) -> None:
        for df in stored:
            discard(self.spark, self.paths.pop(id(df)))


def _firsts(rows: DataFrame, *carried: str) -> DataFrame:
    """Of the suffixes with equal bytes the earliest, and their number.

    Places order the texts as their beginnings do; what else is kept is equal in the group.
    """
    least = [F.min(c).alias(c) for c in ("base", "at", "reach", *carried)]
    return rows.groupBy("bucket", "whole").agg(*least, F.count("*").alias("n"))


def _later(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """Spans of the suffixes whose bytes all occur earlier, counted from the start of their text."""
    r, f = rows.alias("r"), firsts.where("n > 1").select("bucket", "whole", "at").alias("f")
    met = r.join(f, (F.col("r.bucket") == F.col("f.bucket")) & (F.col("r.whole") == F.col("f.whole")))
    start, last = _windows(F.col("r.at") - F.col("r.base"), F.col("r.reach"))
    later = met.where("r.at > f.at")
    return later.select("r.base", start.alias("start"), (last + SIZE).alias("stop"))


def _mixed(firsts: DataFrame, tables: _Tables) -> DataFrame:
    """Buckets with suffixes that differ: these are refined."""
    return tables.keep(firsts.groupBy("bucket").count().where("count > 1").select("bucket"), "mixed-buckets")


def placed(rows: DataFrame, tables: _Tables) -> DataFrame:
    """(id, base, text) of rows (id, ord, t, text): where each text begins if all stand end to end.

    Texts are ordered by (ord, t); rows equal in both are one text. The keys are dealt out
    by ranges, summed up per range, and numbered from the sums of the ranges before.
    """
    size = F.greatest(utf8_length(F.col("text")), F.lit(1))  # an empty text has a place of its own
    keys = tables.keep(rows.groupBy("ord", "t").agg(F.max(size).alias("size")), "keys")
    ranged = keys.repartitionByRange("ord", "t").withColumn("range", F.spark_partition_id())
    ranges = tables.keep(ranged, "ranges")
    tables.drop(keys)
    # As many rows as there are ranges.
    sums = ranges.groupBy("range").agg(F.sum("size").alias("bytes"))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("range", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("start"))
    within = Window.partitionBy("range").orderBy("ord", "t").rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    bases = tables.keep(ranges.join(starts, "range").select("ord", "t", base.alias("base")), "bases")
    tables.drop(ranges)
    r, b = rows.alias("r"), bases.alias("b")
    met = r.join(b, (F.col("r.ord") == F.col("b.ord")) & (F.col("r.t") == F.col("b.t")))
    out = tables.keep(met.select("r.id", "b.base", "r.text"), "placed-texts")
    tables.drop(bases)
    return out


def repeated_spans(docs: DataFrame, tables: _Tables) -> DataFrame:
    """(base, spans) of texts (base, text) that have bytes to remove."""
    rows = tables.keep(docs.where(utf8_length(F.col("text")) >= SIZE).mapInArrow(_scan, SUFFIX), "suffixes")
    shared = tables.keep(rows.groupBy("bucket").count().where("count > 1").select("bucket"), "shared-buckets")
    open_rows = tables.keep(rows.join(shared, "bucket"), "open-suffixes")
    tables.drop(rows, shared)
    firsts = tables.keep(_firsts(open_rows), "firsts")
    found = [tables.keep(_later(open_rows, firsts), "spans")]
    tables.drop(open_rows)

    # Second round: one suffix of each kind is left in buckets that are not settled.
    mixed = _mixed(firsts, tables)
    wanted = tables.keep(
        firsts.join(mixed, "bucket").groupBy("base").agg(F.collect_list(F.struct("at", "reach", "bucket")).alias("wanted")), "wanted"
    )
    tables.drop(mixed, firsts)
    # Rows equal in id and text are one text.
    cut = docs.join(wanted, "base").select("base", F.explode(cut_out("base", "text", "wanted")).alias("c"))
    blocks = tables.keep(cut.select("base", "c.*"), "blocks")
    tables.drop(wanted)
    parts = tables.keep(blocks.mapInArrow(_refine(PART), f"{SUFFIX}, root long, part int"), "parts")
    firsts = tables.keep(_firsts(parts, "root", "part"), "firsts")
    found.append(tables.keep(_later(parts, firsts), "spans"))
    tables.drop(parts)

    # Third round: single windows of the parts that are still mixed.
    mixed = _mixed(firsts, tables)
    still = firsts.join(mixed, "bucket").groupBy("root", "at")
    chosen = tables.keep(still.agg(F.bit_or(F.expr("shiftleft(1L, part)")).alias("parts")), "chosen-parts")
    tables.drop(mixed, firsts)
    b, c = blocks.alias("b"), chosen.alias("c")
    again = b.join(c, (F.col("b.bucket") == F.col("c.root")) & (F.col("b.at") == F.col("c.at"))).select("b.*", "c.parts")
    single = tables.keep(again.mapInArrow(_refine(1), f"{SUFFIX}, root long, part int").drop("root", "part"), "windows")
    tables.drop(blocks, chosen)
    firsts = tables.keep(_firsts(single), "firsts")
    found.append(tables.keep(_later(single, firsts), "spans"))
    tables.drop(single, firsts)

    spans = found[0].unionByName(found[1]).unionByName(found[2])
    merged = spans.groupBy("base").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    out = tables.keep(merged, "spans-of-texts")
    tables.drop(*found)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (``id_col``, n_bytes, n_removed, n_spans, kept_sha256, spans).

    A byte goes if a string of SIZE bytes over it also starts earlier: in a document
    with a smaller id, or further ahead in the same one. All is judged on the input.
    ``spans`` are the runs that go, in bytes of the UTF-8 text.

    Null texts are empty; texts shorter than SIZE bytes lose nothing. Rows without an
    id come last. Different texts with one id are ordered by their hash; rows equal
    in id and text are the same document and do not repeat each other. An empty
    table gives no rows.

    The texts are stored with their places once, and dealt out to the few suffixes that
    are refined and to the spans found. A passage that very many documents hold is
    aggregated before it is shuffled, and joined between two shuffled sides, which
    adaptive execution splits. Columns of any name may stand beside ``id_col`` and ``text``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tables = _Tables(spark)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("ord"),
        F.xxhash64(text).alias("t"),
        F.col(text).cast("binary").alias("text"),
    )
    texts = placed(rows, tables)
    spans = repeated_spans(texts.select("base", "text"), tables)
    done = texts.join(spans, "base", "left").select(
        F.col("id").alias(id_col), utf8_length(F.col("text")).alias("n_bytes"), without("text", "spans").alias("w")
    )
    return done.select(id_col, "n_bytes", "w.n_removed", "w.n_spans", "w.kept_sha256", "w.spans")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("spans")
