"""Which filter removes what, in every order: sorted posting lists and their unions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlag.llm.common import read_table, scratch, store

#: Rows of one part that one row of posting lists covers at most.
RANGE_ROWS = 1 << 16
#: A text with more than one in so many of all rows is joined by broadcast: there are fewer of them.
HOT_TEXTS = 1_000


# ------------------------------------------------------------- posting lists


def held_by(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the sorted ``values`` are in the sorted ``others``; the shorter list gallops.

    Each value of the shorter list is searched in the longer one from where the one
    before it was found, so a list costs its length times the logarithm of the gaps.
    """
    if len(values) == 0 or len(others) == 0:
        return np.zeros(len(values), bool)
    if len(values) <= len(others):
        at = np.minimum(np.searchsorted(others, values), len(others) - 1)
        return others[at] == values
    at = np.minimum(np.searchsorted(values, others), len(values) - 1)
    found = np.zeros(len(values), bool)
    found[at[values[at] == others]] = True
    return found


def union(lists: Sequence[np.ndarray]) -> np.ndarray:
    """Sorted union of sorted lists: into the longest, what it lacks of the others is merged."""
    longest, *rest = sorted(lists, key=len, reverse=True)
    for more in rest:
        new = more[~held_by(more, longest)]
        if len(new):
            longest = np.insert(longest, np.searchsorted(longest, new), new)
    return longest


def posting_lists(rows: DataFrame, names: Sequence[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per part and range of ids: (part, ids, and one list for each of ``names``).

    ``rows`` has part, id, row (a number that tells rows apart) and a boolean column for
    each name. ``ids`` is in order, a list holds the places in ``ids`` of the rows
    for which its column is true. Ids may be null (they come first) or repeat:
    every row has a place of its own. Ranges are dealt out by (id, row), so neither a
    part nor an id that many rows share is one task's work.
    """
    names = list(names)
    held = rows.select("part", "id", "row", *names)
    id_type = held.schema["id"].dataType.simpleString()
    schema = f"part string, ids array<{id_type}>, " + ", ".join(f"`{n}` array<int>" for n in names)
    dealt = held.repartitionByRange("id", "row").sortWithinPartitions("part", "id", "row").drop("row")

    def lists_of(pending: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(pending).combine_chunks()
        columns = [pa.array([table.column("part")[0].as_py()], pa.string())]
        ids = table.column("id").combine_chunks()
        columns.append(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids))
        for name in names:
            flags = table.column(name).fill_null(False).to_numpy(zero_copy_only=False)
            places = pa.array(np.flatnonzero(flags).astype(np.int32))
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), places))
        return pa.RecordBatch.from_arrays(columns, names=["part", "ids", *names])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, held_rows = [], 0
        for batch in batches:
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero(parts[1:] != parts[:-1]) + 1), len(parts)]
            start = 0
            for end in ends:
                while start < end:
                    if pending and (pending[0].column("part")[0].as_py() != parts[start] or held_rows >= range_rows):
                        yield lists_of(pending)
                        pending, held_rows = [], 0
                    taken = min(end - start, range_rows - held_rows)
                    pending.append(batch.slice(start, taken))
                    held_rows += taken
                    start += taken
        if pending:
            yield lists_of(pending)

    return dealt.mapInArrow(ranges, schema)


def union_sizes(postings: DataFrame, filters: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """(part, mask, rows, failing, and a count for each mark) for every set of filters.

    ``mask`` has bit i set if filter i is in the set; ``failing`` counts rows that fail
    one of them, a mark's column those that carry the mark as well. Sizes of ranges
    add up, as a row is in one range only.
    """
    filters, marks = list(filters), list(marks)
    fields = ["rows", "failing", *marks]
    schema = "part string, mask int, " + ", ".join(f"`{f}` long" for f in fields)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                failing = [batch.column(f)[i].values.to_numpy() for f in filters]
                marked = [batch.column(m)[i].values.to_numpy() for m in marks]
                rows = len(batch.column("ids")[i])
                joint = [np.zeros(0, np.int32)]
                for mask in range(1, 1 << len(filters)):
                    low = (mask & -mask).bit_length() - 1
                    joint.append(union([joint[mask & (mask - 1)], failing[low]]))
                out = [[rows, len(u), *(int(held_by(m, u).sum()) for m in marked)] for u in joint]
                columns = [pa.array(c, pa.int64()) for c in zip(*out)]
                part = pa.array([batch.column("part")[i].as_py()] * len(joint), pa.string())
                mask = pa.array(range(len(joint)), pa.int32())
                yield pa.RecordBatch.from_arrays([part, mask, *columns], names=["part", "mask", *fields])

    summed = postings.mapInArrow(sizes, schema)
    return summed.groupBy("part", "mask").agg(*[F.sum(f).alias(f) for f in fields])


def audit(sizes: DataFrame, filters: Sequence[str], marks: dict[str, str]) -> DataFrame:
    """One row per part, order of the filters and step, from the sizes of unions.

    ``marks`` names the column of marked rows lost for each mark. Per part there are
    2^n sizes for n filters, so their list is short.
    """
    filters = list(filters)
    n, full = len(filters), (1 << len(filters)) - 1
    per_part = sizes.groupBy("part").agg(
        F.array_sort(F.collect_list(F.struct("mask", "rows", "failing", *marks))).alias("_of")
    )

    def size(mask: Column, field: str) -> Column:
        return F.element_at("_of", (mask + 1).cast("int"))[field]

    def step(order: Sequence[int], k: int) -> Column:
        before = sum(1 << f for f in order[:k])
        return F.struct(
            F.lit("".join(filters[f] for f in order)).alias("filter_order"),
            F.lit(k + 1).alias("step"),
            F.lit(before).alias("_before"),
            F.lit(1 << order[k]).alias("_own"),
        )

    steps = F.array(*[step(order, k) for order in permutations(range(n)) for k in range(n)])
    own, after = F.col("_own"), F.col("_before").bitwiseOR(F.col("_own"))
    removed = size(after, "failing") - size(F.col("_before"), "failing")
    shapley = F.lit(0).cast("long")
    for mask in range(full + 1):
        orders = factorial(mask.bit_count()) * factorial(n - 1 - mask.bit_count()) if mask != full else 0
        gained = size(F.lit(mask).bitwiseOR(own), "failing") - size(F.lit(mask), "failing")
        if orders:
            shapley = shapley + F.when(F.lit(mask).bitwiseAND(own) == 0, gained * orders).otherwise(F.lit(0))
    figures = {
        "kept": size(F.lit(0), "rows") - size(after, "failing"),
        "removed": removed,
        "redundant": size(own, "failing") - removed,
        "unique_fails": size(F.lit(full), "failing") - size(F.lit(full) - own, "failing"),
        **{out: size(after, mark) - size(F.col("_before"), mark) for mark, out in marks.items()},
        "shapley": shapley,
    }
    unfolded = per_part.select("part", "_of", F.inline(steps))
    return unfolded.select(
        "part", "filter_order", "step", *[value.cast("long").alias(name) for name, value in figures.items()]
    )


# -------------------------------------------------------------- five filters

FILTERS = ("A", "B", "C", "D", "E")
MARKS = {"good": "good_lost", "toxic": "toxic_lost"}


def text_failures(text: Column) -> dict[str, Column]:
    """What texts by themselves fail; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct(words)) * 100 < n * 50,
        "C": F.length(F.regexp_replace(text, "[^A-Z]", "")) * 100 > F.char_length(text) * 3,
        "D": text.rlike("[#$%&*|]"),
    }


def _with_repeats(rows: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``rows`` with E: whether a row with a smaller id has the same digest.

    A text that more than one in ``HOT_TEXTS`` rows share is found by broadcast, and there
    are fewer such texts than that; the others are joined by digest.
    """
    firsts = keep(
        rows.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1"),
        "first-ids",
    )
    many = rows.count() // HOT_TEXTS
    hot = firsts.where(F.col("copies") > many).select("digest", F.col("first_id").alias("hot_id"), F.lit(True).alias("hot"))
    cold = firsts.where(F.col("copies") <= many).select(F.col("digest").alias("key"), "first_id")
    # Rows of hot texts are spread over keys that nothing else has.
    spread = F.concat(F.col("digest"), F.encode(F.col("row").cast("string"), "utf-8"))
    known = rows.join(F.broadcast(hot), "digest", "left").withColumn(
        "key", F.when(F.col("hot"), spread).otherwise(F.col("digest"))
    )
    first = F.coalesce("hot_id", "first_id")
    repeats = first.isNotNull() & (F.col("id").isNull() | (first < F.col("id")))
    return known.join(cold, "key", "left").withColumn("E", repeats).drop("key", "hot", "hot_id", "first_id", "digest")


def _with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with good and toxic, by id; rows without an id meet none and are spread."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("key")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    known = known.withColumn("lost", F.lit(False))
    keyed = rows.withColumns({"key": F.coalesce("id", "row"), "lost": F.col("id").isNull()})
    false = F.lit(False)
    return keyed.join(known, ["key", "lost"], "left").withColumns(
        {m: F.coalesce(m, false) for m in MARKS}
    ).drop("key", "lost")


def document_postings(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored posting lists of the five filters and the two marks, by language.

    Null texts are empty ones, null languages the part ''. E looks at the whole table:
    a row fails it if a row with a smaller id has the same text; a null id is larger than
    all others, so rows without an id do not make others fail. Rows that repeat count
    each by itself. A document labelled more than once carries a mark if one of its
    labels does. Other columns are not read, so their names do not matter; an empty table
    has no parts and gives no rows. Texts are read once, whole.
    """
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)).alias("digest"),
        *[fails.alias(name) for name, fails in text_failures(text).items()],
        # Numbers are stored, so they stay the same when a task is run again.
        F.monotonically_increasing_id().alias("row"),
    )
    with scratch(docs.sparkSession) as keep:
        marked = _with_labels(_with_repeats(keep(rows, "filter-rows"), keep), labels)
        return store(posting_lists(keep(marked, "filter-marks"), [*FILTERS, *MARKS]), "postings")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every order of the five filters over ``docs``, step by step; see ``document_postings``."""
    return audit(union_sizes(document_postings(docs, labels), FILTERS, list(MARKS)), FILTERS, MARKS)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
      FROM labels GROUP BY doc_id),
m AS (
  SELECT part,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN first_id IS NOT NULL AND (doc_id IS NULL OR first_id < doc_id) THEN 16 ELSE 0 END AS mask,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w JOIN firsts USING (t) LEFT JOIN l USING (doc_id)
),
c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY part, mask
),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (
  SELECT k1.f || k2.f || k3.f || k4.f || k5.f AS filter_order, [k1.b, k2.b, k3.b, k4.b, k5.b] AS bits
  FROM k k1, k k2, k k3, k k4, k k5
  WHERE k1.b + k2.b + k3.b + k4.b + k5.b = 31 AND k1.b | k2.b | k3.b | k4.b | k5.b = 31
),
s AS (
  SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
),
r AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before > 0 AND mask & own > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN g ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN x ELSE 0 END) AS toxic_lost
  FROM s, c GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""
