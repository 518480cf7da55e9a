"""A leg feed computed from an ``events`` table.

Every event is one scheduled leg of an aircraft (its user). The formulas are
integer arithmetic on the event id, the user id and the whole part of the value,
so any engine can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlag.operators.sequence import cut_sequences, find_cuts, neighbour

# Stations of the feed and the zone of their clocks.
STATIONS = [
    ("ATL", "America/New_York"),
    ("DEN", "America/Denver"),
    ("DFW", "America/Chicago"),
    ("LAX", "America/Los_Angeles"),
    ("ORD", "America/Chicago"),
    ("PHX", "America/Phoenix"),
    ("HNL", "Pacific/Honolulu"),
]
LAST_STATION = ("SEA", "America/Los_Angeles")
FEED_CARRIERS = ["AA", "DL", "WN", "UA", "OO"]


def _nth(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b))


def legs_from_events(events: DataFrame, max_rows: int = 2_000_000) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    v = F.floor("value")
    station = F.pmod(3 * i + u, F.lit(len(STATIONS)))
    base = events.select(
        "event_id",
        "user_id",
        "ts",
        v.cast("int").alias("_v"),
        _nth([code for code, _ in STATIONS], station).alias("origin"),
        F.from_utc_timestamp(
            F.col("ts").cast("timestamp"), _nth([zone for _, zone in STATIONS], station)
        ).alias("_local"),
    )
    cuts = find_cuts(base, ["user_id"], "ts", ["ts", "event_id"], ["origin"], max_rows, label="feed_cuts")
    base = neighbour(cut_sequences(base, cuts), "origin", "_next", following=True).drop_chunk()

    cancelled = i % 53 == 0
    diverted = ~cancelled & (i % 211 == 0)
    lands_last = (i % 11 == 0) | F.col("_next").isNull()
    legs = base.withColumns(
        {
            "flight_date": F.col("_local").cast("date"),
            "crs_dep_time": (F.hour("_local") * 100 + F.minute("_local")).cast("int"),
            "dest": F.when(lands_last, F.lit(LAST_STATION[0])).otherwise(F.col("_next")),
            "carrier": _nth(FEED_CARRIERS, u % 5),
            "tail_number": F.when(u % 50 == 49, F.lit("UNKNOW")).otherwise(
                F.concat(F.lit("N"), (u + 100).cast("string"))
            ),
            "flight_number": (i % 9000).cast("int"),
            "crs_elapsed_time": F.when(i % 997 == 0, F.lit(-30)).otherwise(45 + i % 120).cast("int"),
            "cancelled": cancelled,
            "diverted": diverted,
            "cancellation_code": F.when(cancelled, _nth(list("ABCD"), _div(i, 53) % 4)),
            "arr_delay": F.when(~(cancelled | diverted), F.col("_v") - 25).cast("int"),
            "dep_delay": F.when(~cancelled, F.col("_v") - 20 + i % 10).cast("int"),
            "taxi_out": F.when(~cancelled, 8 + i % 20).cast("int"),
            "distance_miles": 200.0 + (i % 40) * 50,
        }
    ).withColumns(
        {
            "year": F.year("flight_date"),
            "quarter": F.quarter("flight_date"),
            "month": F.month("flight_date"),
            "day_of_month": F.day("flight_date"),
            "day_of_week": F.weekday("flight_date") + 1,
            "arr_delay_minutes": F.when(
                F.col("arr_delay").isNotNull(), F.greatest(F.col("arr_delay"), F.lit(0))
            ),
            "dep_delay_minutes": F.when(
                F.col("dep_delay").isNotNull(), F.greatest(F.col("dep_delay"), F.lit(0))
            ),
            "arr_del15": F.col("arr_delay") >= 15,
            "dep_del15": F.col("dep_delay") >= 15,
            "actual_elapsed_time": F.col("crs_elapsed_time") + F.col("arr_delay") - F.col("dep_delay"),
            **_causes(i),
        }
    )
    return legs.withColumn(
        "air_time", F.col("actual_elapsed_time") - F.col("taxi_out") - 5
    ).drop("_v", "_local", "_next", "ts", "user_id")


def _causes(i: Column) -> dict[str, Column]:
    """Cause minutes of legs 15 or more minutes late."""
    d = F.col("arr_delay")
    late, weather, nas, security = (
        F.when(i % 2 == 0, _div(d * 6, 10)).otherwise(0),
        F.when(i % 7 == 0, _div(d, 10)).otherwise(0),
        F.when(i % 3 == 0, _div(d * 2, 10)).otherwise(0),
        F.when(i % 101 == 0, _div(d, 20)).otherwise(0),
    )
    reported = i % 1999 != 0

    def cell(minutes: Column) -> Column:
        return F.when(d >= 15, F.when(reported, minutes).otherwise(0)).cast("int")

    return {
        "carrier_delay": cell(d - late - weather - nas - security),
        "weather_delay": cell(weather),
        "nas_delay": cell(nas),
        "security_delay": cell(security),
        "late_aircraft_delay": cell(late),
    }


def station_zones() -> list[tuple[str, str]]:
    return [*STATIONS, LAST_STATION]
