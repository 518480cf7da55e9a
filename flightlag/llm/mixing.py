"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightlag.llm.common import read_table, store

#: Weights of sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: A source is ranked in so many pieces of its key range; a piece is what one task orders.
PIECES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plain_share(text: Column) -> Column:
    """A quality weight from 0.1 to 1: the share of characters that are not digits or signs."""
    signs = "0123456789#$%&*|!<>{}[]=+_/@"
    kept = F.length(F.translate(text, signs, ""))
    return F.coalesce(0.1 + 0.9 * kept / F.nullif(F.length(text), F.lit(0)), F.lit(0.1))


def uniform(*parts: Column) -> Column:
    """A number above 0 and below 1 that depends on ``parts`` only: 52 bits of their MD5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: float = MAX_REPEATS
) -> DataFrame:
    """(source, source_size) with ``target``: words the mix shall take from the source.

    Sources in the order of code points, null last, weigh ``weights`` in turn. The
    targets share the sum of all sizes; none is above ``max_repeats`` times its
    source's size, and what that frees is shared again by weight. In the order of
    ``cap / weight`` the capped sources come first, so one running sum finds them.
    The table has one row per source; its windows are not partitioned.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    everything = Window.partitionBy()
    caps = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weights", F.sum("weight").over(everything))
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    before_cap = F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))
    before_weight = F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    level = (F.col("total") - before_cap) / (F.col("all_weights") - before_weight)
    levels = caps.withColumn("level", level)
    free = F.col("cap") / F.col("weight") > F.col("level")
    # Levels rise up to the first source that is not capped and fall after it; that one's holds for all.
    rate = F.coalesce(F.max(F.when(free, F.col("level"))).over(everything), F.lit(float("inf")))
    return levels.select(
        "source", "source_size", F.least(F.col("cap"), F.col("weight") * rate).alias("target")
    )


def _piece(key: Column, pieces: int) -> Column:
    """A step of ``ln(key)`` in which lies one in ``pieces`` of the rows of a quality at most.

    ``key`` is exponential at a rate of the quality, so the density of its logarithm is
    1 / e at most, whatever the quality.
    """
    return F.when(key > 0, F.floor(F.log(key) * (pieces / math.e)).cast("int")).when(key <= 0, F.lit(-(1 << 31)))


def mix(
    rows: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_repeats: float = MAX_REPEATS,
    pieces: int = PIECES,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Narrow rows (doc_id, source, size, quality, u) with source_size, target, copies, taken.

    Of other columns those named in ``carry`` stay.

    A source whose target is n times its size or more gives n complete epochs. For
    the rest its documents are ordered by ``-ln(u) / quality`` and taken while the
    middle of a document lies within what is left, so a source ends within half a
    document of its target. Each document is taken n or n + 1 times.

    A source may hold any share of the rows: it is cut by key into pieces, of which
    none has much more than one in ``pieces`` of its rows, whatever their qualities. Sums
    per piece say how many words come before it, and only rows within a piece are
    ordered. Key ties are ordered by doc_id and size. A quality that is null or not
    above 0 counts as the least positive one; a null size counts as 0. Empty tables
    give empty results; sources without words have target 0.
    """
    quality = F.when(F.col("quality") > 0, F.col("quality")).otherwise(F.lit(1e-9))
    key = -F.log(F.col("u")) / quality
    keyed = rows.select(
        "doc_id", "source", *carry, F.coalesce("size", F.lit(0)).cast("long").alias("size"), key.alias("key")
    ).withColumn("piece", _piece(F.col("key"), pieces))
    keyed = store(keyed, "mix-rows")

    per_piece = store(keyed.groupBy("source", "piece").agg(F.sum("size").alias("words")), "mix-pieces")
    sizes = per_piece.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeats)
    earlier = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_piece.withColumn("start", F.coalesce(F.sum("words").over(earlier), F.lit(0))).alias("p")
    known = starts.join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select(
        "p.source", "p.piece", "p.start", "t.source_size", "t.target"
    )
    known = store(known, "mix-starts")

    k, p = keyed.alias("k"), known.alias("p")
    met = k.join(p, F.col("k.source").eqNullSafe(F.col("p.source")) & (F.col("k.piece") == F.col("p.piece"))).select(
        "k.*", "p.start", "p.source_size", "p.target"
    )
    in_piece = (
        Window.partitionBy("source", "piece").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.col("start") + F.coalesce(F.sum("size").over(in_piece), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return (
        met.withColumn("before", before)
        .withColumn("epochs", epochs)
        .withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("copies", F.col("epochs") + (F.col("before") + F.col("size") / 2.0 < F.col("left")).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("doc_id", "source", *carry, "size", "source_size", "target", "copies", "taken")
    )


def mix_rows(docs: DataFrame) -> DataFrame:
    """What ``mix`` needs of documents; the text is read once and left behind."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        "source",
        F.xxhash64(text).alias("text_hash"),
        word_count(text).alias("size"),
        plain_share(text).alias("quality"),
        # Rows that share an id, as null ids do, still get numbers of their own.
        uniform(F.col("doc_id"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("u"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(mix_rows(read_table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         coalesce(0.1 + 0.9 * length(translate(text, '0123456789#$%&*|!<>{}[]=+_/@', ''))
                            / nullif(length(text), 0), 0.1) AS quality,
         md5(coalesce(doc_id::VARCHAR, '\N') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents
), k AS (
  SELECT *, -ln((('0x' || h[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / quality AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n
  FROM d GROUP BY source
), w AS (
  SELECT source, source_size, n, ((n - 1) % 3 + 1)::DOUBLE AS weight, 3.0 * source_size::DOUBLE AS cap,
         (sum(source_size) OVER ())::DOUBLE AS total, sum(((n - 1) % 3 + 1)::DOUBLE) OVER () AS all_weights
  FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (all_weights - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w
  WINDOW b AS (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size,
         least(cap, weight * coalesce(max(level) FILTER (cap / weight > level) OVER (), 'inf'::DOUBLE)) AS target
  FROM l
), m AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       ((epochs + CASE WHEN earlier + size / 2.0 < target - epochs * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM m
"""
