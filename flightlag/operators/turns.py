"""Consecutive legs linked into turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlag.functions.clock import minutes_between

# Fixed value: shape of a registration, to the very end of the text.
TAIL_PATTERN = r"^N[0-9][0-9A-Z]{1,4}\z"


def real_tail(tail: Column) -> Column:
    """Whether the text is a registration rather than a placeholder."""
    return tail.isNotNull() & tail.rlike(TAIL_PATTERN)


def flyable_legs(flights: DataFrame) -> DataFrame:
    """Completed legs of a known aircraft with both actual instants."""
    return flights.filter(
        F.col("completed")
        & real_tail(F.col("tail_number"))
        & F.col("actual_arr_utc").isNotNull()
        & F.col("actual_dep_utc").isNotNull()
    )


def continues_turn(max_minutes: int) -> Column:
    """Same station, a known planned arrival, and a gap short enough for a turn."""
    linked = (
        (F.col("prev_dest") == F.col("origin"))
        & F.col("prev_sched_arr_utc").isNotNull()
        & F.col("sched_turn_minutes").between(0, max_minutes)
    )
    return F.coalesce(linked, F.lit(False))


def link_turns(legs: DataFrame, max_minutes: int = 720) -> DataFrame:
    """Add planned and actual turn minutes and whether the leg continues a rotation."""
    return legs.withColumns(
        {
            "sched_turn_minutes": minutes_between(
                F.col("prev_sched_arr_utc"), F.col("sched_dep_utc")
            ),
            "actual_turn_minutes": minutes_between(
                F.col("prev_actual_arr_utc"), F.col("actual_dep_utc")
            ),
        }
    ).withColumn("is_continuation", continues_turn(max_minutes))
