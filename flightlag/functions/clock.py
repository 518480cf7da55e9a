"""Local clock fields to instants, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hhmm_hour(hhmm: Column, mode: str = "floor") -> Column:
    """Hour of an HHMM integer; 2400 gives 24."""
    hours = hhmm / F.lit(100)
    if mode == "floor":
        return F.floor(hours).cast("int")
    if mode == "round":
        return F.rint(hours).cast("int")
    raise ValueError(f"clock mode must be floor or round, not {mode!r}")


def hhmm_to_local(day: Column, hhmm: Column, mode: str = "floor") -> Column:
    """Wall-clock timestamp (no zone); 2400 is midnight of the next day."""
    minutes = hhmm_hour(hhmm, mode) * F.lit(60) + hhmm % F.lit(100)
    return F.timestamp_add("MINUTE", minutes, day.cast("timestamp_ntz"))


def local_to_instant(local: Column, zone: Column) -> Column:
    """Instant at which clocks in ``zone`` show ``local``; needs a UTC session.

    A time skipped in spring moves forward. A time shown twice in autumn is the
    second one, so the hour after Spark's (earlier) answer is tried as well.
    """
    wall = local.cast("timestamp")
    earlier = F.to_utc_timestamp(wall, zone)
    later = plus_minutes(earlier, F.lit(60))
    return F.when(F.from_utc_timestamp(later, zone) == wall, later).otherwise(earlier)


def plus_minutes(instant: Column, *minutes: Column) -> Column:
    """Instant moved by whole minutes, in plain long arithmetic."""
    micros = F.unix_micros(instant)
    for step in minutes:
        micros = micros + step.cast("long") * F.lit(60_000_000)
    return F.timestamp_micros(micros)


def epoch_minute(instant: Column) -> Column:
    return F.floor(F.unix_seconds(instant) / F.lit(60)).cast("long")


def minutes_between(start: Column, end: Column) -> Column:
    """Minute boundaries crossed from start to end."""
    return epoch_minute(end) - epoch_minute(start)


def month_first(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))
