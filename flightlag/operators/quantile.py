"""Exact quantiles of wide domains by selection: counts of digits instead of values.

A percentile aggregate holds every distinct value of a group in one buffer. Here the
bits of the wanted order statistics are found sixteen at a time, from the highest: a
round counts the rows that share the bits found so far by their next sixteen, where map
tasks combine, so no task ever holds more than 65,536 counts for a quantile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightlag.functions.numeric import from_units, whole_units
from flightlag.operators.sequence import Keep
from flightlag.sources.tables import keep_in_scratch

WORD, BITS = 64, 16
DIGIT = (1 << BITS) - 1


def _ordered(value: Column) -> Column:
    """A long whose bits, read without sign, are in the order of ``value``."""
    return value.bitwiseXOR(F.lit(-(1 << (WORD - 1))))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    quantiles: dict[str, float],
    places: int | None = None,
    keep: Keep = keep_in_scratch,
) -> DataFrame:
    """(keys, known, one column per quantile): interpolated between order statistics.

    ``value`` is a whole number, or with ``places`` a decimal number of so many places.
    Rows without a value do not count; groups without any have no quantiles. Keys may be
    null. Four rounds read the two columns each; what a round finds, two rows at most per
    group and quantile, is kept and joined to the rows of the next.
    """
    keys = list(keys)
    units = value.cast("long") if places is None else whole_units(value, places)
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.select(group.alias("_k"), units.alias("_v"))
    sizes = keep(rows.groupBy("_k").agg(F.count("_v").alias("known")), "quantile_sizes")
    bits = rows.filter(F.col("_v").isNotNull()).select("_k", _ordered(F.col("_v")).alias("_b"))

    def place(p: float) -> Column:
        return F.lit(p) * (F.col("known") - 1)

    ranks = [rank(place(p)).cast("long") for p in quantiles.values() for rank in (F.floor, F.ceil)]
    wanted = sizes.filter(F.col("known") > 0).select("_k", F.explode(F.array_distinct(F.array(*ranks))).alias("_rank"))
    # The bits found so far, and the rank among the rows that share them.
    state = wanted.withColumns({"_left": F.col("_rank"), "_found": F.lit(0).cast("long")})
    for level in range(WORD // BITS):
        state = keep(state, f"quantile_{level}")
        shift = WORD - BITS * level
        found = F.lit(0).cast("long") if level == 0 else F.shiftrightunsigned("_b", shift)
        digit = F.shiftrightunsigned("_b", shift - BITS).bitwiseAND(F.lit(DIGIT).cast("long"))
        open_rows = bits.select("_k", found.alias("_found"), digit.alias("_digit")).join(
            state.select("_k", "_found").distinct(), ["_k", "_found"]
        )
        counts = open_rows.groupBy("_k", "_found", "_digit").agg(F.count("*").alias("_n"))
        earlier = Window.partitionBy("_k", "_found").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
        spans = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        here = (F.col("_left") >= F.col("_before")) & (F.col("_left") < F.col("_before") + F.col("_n"))
        state = state.join(spans, ["_k", "_found"]).filter(here).select(
            "_k",
            "_rank",
            (F.col("_left") - F.col("_before")).alias("_left"),
            F.shiftleft("_found", BITS).bitwiseOR(F.col("_digit")).alias("_found"),
        )
    # Twice as many entries as quantiles at most.
    entry = F.struct("_rank", _ordered(F.col("_found")).alias("_v"))
    told = state.groupBy("_k").agg(F.map_from_entries(F.collect_list(entry)).alias("_at"))

    def interpolated(p: float) -> Column:
        low, high = (F.try_element_at("_at", rank(place(p)).cast("long")) for rank in (F.floor, F.ceil))
        if places is not None:
            low, high = from_units(low, places), from_units(high, places)
        return low + (high - low) * (place(p) - F.floor(place(p)))

    answer = sizes.join(told, "_k", "left")
    named = [F.col("_k")[k].alias(k) for k in keys]
    return answer.select(*named, "known", *[interpolated(p).cast("double").alias(name) for name, p in quantiles.items()])
