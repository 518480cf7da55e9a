"""Airports, carriers and the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlag.functions.labels import size_band
from flightlag.functions.numeric import ratio
from flightlag.operators.periods import join_periods
from flightlag.sources.reference import carrier_lookup, holidays, thanksgiving_periods


def airport_activity(flights: DataFrame) -> DataFrame:
    """Departures and arrivals per airport; either side may be missing.

    Legs are counted per route once; both sides then start from that short table.
    """
    routes = flights.groupBy("origin", "dest").agg(F.count("*").alias("n"))
    out = routes.groupBy(F.col("origin").alias("airport_code")).agg(F.sum("n").alias("departures"))
    into = routes.groupBy(F.col("dest").alias("airport_code")).agg(F.sum("n").alias("arrivals"))
    return out.join(into, "airport_code", "full_outer").select(
        "airport_code",
        F.coalesce("departures", F.lit(0)).alias("departures"),
        F.coalesce("arrivals", F.lit(0)).alias("arrivals"),
    )


def dim_airport(activity: DataFrame, airports: DataFrame) -> DataFrame:
    """Airports seen in the feed, with reference data, departure share and size."""
    everything = activity.agg(F.sum("departures")).scalar()
    known = airports.withColumn("is_mapped", F.lit(True))
    return (
        activity.withColumn("departure_share", ratio(F.col("departures"), everything))
        .withColumn("size_band", size_band(F.col("departure_share")))
        .join(known, "airport_code", "left")
        .select(
            "airport_code",
            "airport_name",
            "city",
            "country",
            "latitude",
            "longitude",
            "timezone",
            "departures",
            "arrivals",
            "departure_share",
            "size_band",
            F.coalesce("is_mapped", F.lit(False)).alias("is_mapped"),
        )
    )


def dim_carrier(flights: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Carriers seen in the feed, named from the lookup where it knows them."""
    if lookup is None:
        lookup = carrier_lookup(flights.sparkSession)
    seen = flights.groupBy("carrier").agg(
        F.count("*").alias("flights"),
        F.min("flight_date").alias("first_seen"),
        F.max("flight_date").alias("last_seen"),
    )
    unnamed = F.concat(F.lit("UNKNOWN ("), F.col("carrier"), F.lit(")"))
    return seen.join(lookup.withColumn("_known", F.lit(True)), "carrier", "left").select(
        "carrier",
        F.coalesce("carrier_name", unnamed).alias("carrier_name"),
        F.coalesce("carrier_type", F.lit("Unknown")).alias("carrier_type"),
        "operates_for",
        F.coalesce("_known", F.lit(False)).alias("is_mapped"),
        "flights",
        "first_seen",
        "last_seen",
    )


def calendar(span: DataFrame) -> DataFrame:
    """One row per day of a (first_day, last_day) row."""
    return span.select(F.explode(F.sequence("first_day", "last_day")).alias("date_day"))


def dim_date(days: DataFrame) -> DataFrame:
    """Calendar attributes, federal holidays and travel periods for any range."""
    day = F.col("date_day")
    years = days.select(F.year(day).alias("year")).distinct()
    new_year = F.trunc(day, "year")
    season = (F.month(day) == 12) & (F.day(day) >= 20) | (F.month(day) == 1) & (F.day(day) <= 3)
    summer = day.between(F.date_add(new_year, 150), F.date_add(new_year, 248))
    iso_day = F.weekday(day) + 1
    return (
        join_periods(
            days.join(holidays(years), "date_day", "left"),
            "date_day",
            thanksgiving_periods(years),
            "window_start",
            "window_end",
        )
        .select(
            "date_day",
            F.year(day).alias("year"),
            F.quarter(day).alias("quarter"),
            F.month(day).alias("month"),
            F.date_format(day, "MMMM").alias("month_name"),
            F.day(day).alias("day_of_month"),
            iso_day.alias("iso_day_of_week"),
            F.date_format(day, "EEEE").alias("day_name"),
            (iso_day >= 6).alias("is_weekend"),
            "holiday_name",
            F.col("holiday_name").isNotNull().alias("is_federal_holiday"),
            F.when(F.col("label").isNotNull(), F.col("label"))
            .when(season, F.lit("Christmas / New Year"))
            .when(summer, F.lit("Summer peak"))
            .alias("travel_period"),
        )
    )
