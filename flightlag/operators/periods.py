"""Days matched to periods given by first and last day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def days_of(periods: DataFrame, start: str, end: str, day: str) -> DataFrame:
    """One row per day of each period."""
    return periods.withColumn(day, F.explode(F.sequence(F.col(start), F.col(end)))).drop(start, end)


def join_periods(
    df: DataFrame, day: str, periods: DataFrame, start: str, end: str
) -> DataFrame:
    """Left join rows to every period that contains their day.

    Periods are unfolded into days, so this is an equi-join that can be hashed,
    not a comparison of every row with every period.
    """
    return df.join(days_of(periods, start, end, day), [day], "left")


#: Seconds of the bins that windows are cut into, each level sixteen times the one before.
BIN_SECONDS = tuple(60 * 16**level for level in range(7))


def join_windows(
    points: DataFrame,
    at: str,
    windows: DataFrame,
    start: str,
    end: str,
    keys: Sequence[str] = (),
    bin_seconds: Sequence[int] = BIN_SECONDS,
) -> DataFrame:
    """Each point with every window [start, end) that its instant is in, and equal ``keys``.

    A window lies in the bins of the narrowest level that is no shorter than itself, so in
    two at most, however long it is; a point has one bin per level that some window has. Bins
    are met by equality and the ends are compared then, so a pair is found once. Points and
    windows without an instant, and windows that end no later than they start, meet nothing.
    Columns of both sides other than ``keys`` need different names.
    """
    widths = [int(s * 1_000_000) for s in bin_seconds]
    first, last = F.unix_micros(F.col(start)), F.unix_micros(F.col(end))
    fitting = F.coalesce(*[F.when(last - first <= w, F.lit(w)) for w in widths], F.lit(widths[-1])).cast("long")
    held = windows.filter(F.col(start) < F.col(end)).withColumn("_width", fitting)
    # A handful of numbers: the levels in use.
    used = [r["_width"] for r in held.select("_width").distinct().collect()] or widths[:1]

    def bin_of(instant: Column, width: Column) -> Column:
        return instant - F.pmod(instant, width)

    width = F.col("_width")
    bins = F.sequence(bin_of(first, width), bin_of(last - 1, width), width)
    held = held.withColumn("_bin", F.explode(bins))
    levels = F.explode(F.array(*[F.lit(w).cast("long") for w in sorted(used)]))
    dealt = points.filter(F.col(at).isNotNull()).withColumn("_width", levels)
    dealt = dealt.withColumn("_bin", bin_of(F.unix_micros(F.col(at)), width))
    met = dealt.join(held, [*keys, "_width", "_bin"])
    return met.filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_width", "_bin")
