"""The declared feed: source column, name and kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns kept from the monthly feed, in file order.
FEED_COLUMNS = [
    ("Year", "year", "int"),
    ("Quarter", "quarter", "int"),
    ("Month", "month", "int"),
    ("DayofMonth", "day_of_month", "int"),
    ("DayOfWeek", "day_of_week", "int"),
    ("FlightDate", "flight_date", "date"),
    ("Reporting_Airline", "carrier", "str"),
    ("DOT_ID_Reporting_Airline", "carrier_dot_id", "int"),
    ("Tail_Number", "tail_number", "str"),
    ("Flight_Number_Reporting_Airline", "flight_number", "int"),
    ("OriginAirportID", "origin_airport_id", "int"),
    ("Origin", "origin", "str"),
    ("OriginCityName", "origin_city", "str"),
    ("OriginState", "origin_state", "str"),
    ("OriginStateName", "origin_state_name", "str"),
    ("DestAirportID", "dest_airport_id", "int"),
    ("Dest", "dest", "str"),
    ("DestCityName", "dest_city", "str"),
    ("DestState", "dest_state", "str"),
    ("DestStateName", "dest_state_name", "str"),
    ("CRSDepTime", "crs_dep_time", "hhmm"),
    ("DepTime", "dep_time", "hhmm"),
    ("DepDelay", "dep_delay", "minutes"),
    ("DepDelayMinutes", "dep_delay_minutes", "minutes"),
    ("DepDel15", "dep_del15", "bool"),
    ("DepTimeBlk", "dep_time_block", "str"),
    ("TaxiOut", "taxi_out", "minutes"),
    ("WheelsOff", "wheels_off", "hhmm"),
    ("WheelsOn", "wheels_on", "hhmm"),
    ("TaxiIn", "taxi_in", "minutes"),
    ("CRSArrTime", "crs_arr_time", "hhmm"),
    ("ArrTime", "arr_time", "hhmm"),
    ("ArrDelay", "arr_delay", "minutes"),
    ("ArrDelayMinutes", "arr_delay_minutes", "minutes"),
    ("ArrDel15", "arr_del15", "bool"),
    ("ArrTimeBlk", "arr_time_block", "str"),
    ("Cancelled", "cancelled", "bool"),
    ("CancellationCode", "cancellation_code", "str"),
    ("Diverted", "diverted", "bool"),
    ("CRSElapsedTime", "crs_elapsed_time", "minutes"),
    ("ActualElapsedTime", "actual_elapsed_time", "minutes"),
    ("AirTime", "air_time", "minutes"),
    ("Distance", "distance_miles", "num"),
    ("DistanceGroup", "distance_group", "int"),
    ("CarrierDelay", "carrier_delay", "minutes"),
    ("WeatherDelay", "weather_delay", "minutes"),
    ("NASDelay", "nas_delay", "minutes"),
    ("SecurityDelay", "security_delay", "minutes"),
    ("LateAircraftDelay", "late_aircraft_delay", "minutes"),
]

KIND_TYPES = {
    "int": T.IntegerType(),
    "hhmm": T.IntegerType(),
    "minutes": T.IntegerType(),
    "num": T.DoubleType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
    "str": T.StringType(),
}

FEED_SCHEMA = T.StructType(
    [T.StructField(name, KIND_TYPES[kind]) for _, name, kind in FEED_COLUMNS]
)


def cast_text(text: Column, kind: str) -> Column:
    """Typed value of a text cell; what does not parse is NULL."""
    if kind == "str":
        return F.nullif(F.trim(text), F.lit(""))
    if kind == "bool":
        return text.try_cast("double") == F.lit(1.0)
    if kind == "minutes":
        return F.rint(text.try_cast("double")).try_cast("int")
    if kind in ("int", "hhmm"):
        return F.coalesce(text.try_cast("int"), F.round(text.try_cast("double")).try_cast("int"))
    if kind in ("num", "date"):
        return text.try_cast(KIND_TYPES[kind])
    raise ValueError(f"unknown kind {kind!r}")


def text_cell(value: Column, kind: str) -> Column:
    """The feed's text form of a typed value; NULL is an empty cell."""
    if kind == "minutes":
        return F.concat(value.cast("string"), F.lit(".00"))
    if kind == "bool":
        return F.when(value, F.lit("1.00")).when(~value, F.lit("0.00"))
    if kind == "hhmm":
        return F.lpad(value.cast("string"), 4, "0")
    return value.cast("string")
