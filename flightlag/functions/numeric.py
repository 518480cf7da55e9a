"""Rounding and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: Column, digits: int) -> Column:
    """Round the scaled double, so 1.005 goes to 1.0 as binary arithmetic has it."""
    scale = float(10**digits)
    return F.round(value.cast("double") * scale, 0) / F.lit(scale)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient as a double; NULL where the divisor is zero."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def percent(top: Column, bottom: Column) -> Column:
    return ratio(F.lit(100.0) * top, bottom)


def rate(hits: Column, rows: Column) -> Column:
    """Mean of a flag in percent: the quotient is rounded before it is scaled."""
    return F.lit(100.0) * ratio(hits, rows)


def floor_at_zero(value: Column) -> Column:
    """Negative and missing amounts count as nothing."""
    return F.greatest(value, F.lit(0))


def pearson(x: Column, y: Column) -> Column:
    """Correlation that is NULL, not an error, when one side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def open_bucket(value: Column, width: int, top: int) -> Column:
    """Lower edge of the bucket; the bucket starting at ``top`` has no upper edge."""
    return F.least(F.floor(value / F.lit(width)) * F.lit(width), F.lit(top)).cast("long")


def whole_units(value: Column, places: int) -> Column:
    """A decimal number as a count of its last place, for exact sums."""
    return F.round(value.cast("double") * float(10**places), 0).cast("long")


def from_units(units: Column, places: int) -> Column:
    return units.cast("double") / F.lit(float(10**places))
