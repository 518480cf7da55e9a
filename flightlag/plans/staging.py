"""Flight records with instants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlag.functions.clock import hhmm_to_local, local_to_instant, plus_minutes

DAY_MINUTES = 24 * 60


def _minutes_ahead(local: Column, zone: Column) -> Column:
    """Minutes from the wall clock to the instant it shows."""
    wall = F.unix_seconds(local.cast("timestamp"))
    return ((F.unix_seconds(local_to_instant(local, zone)) - wall) / 60).cast("int")


def zone_offsets(airports: DataFrame, first: Column, last: Column) -> DataFrame:
    """Clock offset of every zone on every day from first to last: one row each.

    ``offset`` holds from midnight, ``late_offset`` from ``changes_at`` (a minute
    of the day) on days the clocks change. Zone rules are looked up per zone and
    day here rather than per flight.
    """
    zone, day = F.col("zone"), F.col("day").cast("timestamp_ntz")
    zones = airports.filter("timezone IS NOT NULL").select(F.col("timezone").alias("zone")).distinct()
    every = zones.withColumn("day", F.explode(F.sequence(first, last)))

    def at(minute: Column) -> Column:
        return _minutes_ahead(F.timestamp_add("MINUTE", minute, day), zone)

    unchanged = F.filter(
        F.sequence(F.lit(0), F.lit(DAY_MINUTES - 1)), lambda m: at(m) == F.col("offset")
    )
    return (
        every.withColumns({"offset": at(F.lit(0)), "late_offset": at(F.lit(DAY_MINUTES))})
        .withColumn(
            "changes_at", F.when(F.col("offset") != F.col("late_offset"), F.size(unchanged))
        )
    )


def _departure(ends: DataFrame, offsets: DataFrame | None) -> DataFrame:
    """Add the departure instant, from the offset table where one is given."""
    local, zone = F.col("sched_dep_local"), F.col("origin_tz")
    direct = local_to_instant(local, zone)
    if offsets is None:
        return ends.withColumn("sched_dep_utc", direct)
    wall = local.cast("timestamp")
    minute = F.pmod(F.floor(F.unix_seconds(wall) / 60), F.lit(DAY_MINUTES))
    ahead = F.when(minute >= F.col("changes_at"), F.col("late_offset")).otherwise(F.col("offset"))
    table = offsets.withColumnsRenamed({"zone": "origin_tz", "day": "_day"})
    return (
        ends.withColumn("_day", local.cast("date"))
        .join(table, ["origin_tz", "_day"], "left")
        .withColumn("sched_dep_utc", F.coalesce(plus_minutes(wall, ahead), direct))
        .drop("_day", "offset", "late_offset", "changes_at")
    )


def stg_flight(
    feed: DataFrame,
    airports: DataFrame,
    clock: str = "floor",
    offsets: DataFrame | None = None,
) -> DataFrame:
    """Join the zones of both ends and derive all instants from the departure.

    Arrivals are counted forward from the planned departure, so no local arrival
    field has to be resolved. A leg planned to take no time has no arrival.
    """
    zones = airports.select("airport_code", "timezone")
    ends = feed
    for end in ("origin", "dest"):
        ends = ends.join(
            zones.select(F.col("airport_code").alias(end), F.col("timezone").alias(f"{end}_tz")),
            end,
            "left",
        )
    ends = ends.withColumn(
        "sched_dep_local", hhmm_to_local(F.col("flight_date"), F.col("crs_dep_time"), clock)
    )
    valid = F.col("crs_elapsed_time") > 0
    flown, landed = ~F.col("cancelled"), ~F.col("cancelled") & ~F.col("diverted")
    departure, block = F.col("sched_dep_utc"), F.col("crs_elapsed_time")
    return _departure(ends, offsets).withColumns(
        {
            "is_schedule_valid": valid,
            "sched_arr_utc": F.when(valid, plus_minutes(departure, block)),
            "actual_dep_utc": F.when(flown, plus_minutes(departure, F.col("dep_delay"))),
            "actual_arr_utc": F.when(
                landed & valid, plus_minutes(departure, block, F.col("arr_delay"))
            ),
        }
    )
