"""Small inline tables and the calendar rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Carriers of the feed by code.
CARRIERS = [
    # Network
    ("AA", "American Airlines", "Network", None),
    ("DL", "Delta Air Lines", "Network", None),
    ("UA", "United Airlines", "Network", None),
    ("AS", "Alaska Airlines", "Network", None),
    ("HA", "Hawaiian Airlines", "Network", None),
    # Low-cost
    ("WN", "Southwest Airlines", "Low-cost", None),
    ("B6", "JetBlue Airways", "Low-cost", None),
    ("SY", "Sun Country Airlines", "Low-cost", None),
    ("MX", "Breeze Airways", "Low-cost", None),
    # Ultra low-cost
    ("NK", "Spirit Airlines", "Ultra low-cost", None),
    ("F9", "Frontier Airlines", "Ultra low-cost", None),
    ("G4", "Allegiant Air", "Ultra low-cost", None),
    # Regional
    ("OO", "SkyWest Airlines", "Regional", "AA / DL / UA / AS"),
    ("YX", "Republic Airways", "Regional", "AA / DL / UA"),
    ("MQ", "Envoy Air", "Regional", "AA"),
    ("OH", "PSA Airlines", "Regional", "AA"),
    ("PT", "Piedmont Airlines", "Regional", "AA"),
    ("9E", "Endeavor Air", "Regional", "DL"),
    ("YV", "Mesa Airlines", "Regional", "AA / UA"),
    ("ZW", "Air Wisconsin", "Regional", "AA / UA"),
    ("C5", "CommuteAir", "Regional", "UA"),
    ("G7", "GoJet Airlines", "Regional", "UA"),
    ("QX", "Horizon Air", "Regional", "AS"),
    ("EV", "ExpressJet Airlines", "Regional", "UA"),
    ("AX", "Trans States Airlines", "Regional", "UA"),
    ("9K", "Cape Air", "Regional", "Independent / EAS"),
    ("KS", "PenAir", "Regional", "Independent / EAS"),
    ("EM", "Empire Airlines", "Regional", "Independent"),
]

# Airports the reference file lacks or has without a zone.
AIRPORT_OVERRIDES = [
    ("XWA", "Williston Basin International Airport", "Williston", "United States",
     48.2581, -103.7486, "America/Chicago"),
    ("BIH", "Eastern Sierra Regional Airport", "Bishop", "United States",
     37.3731, -118.3636, "America/Los_Angeles"),
    ("EAR", "Kearney Regional Airport", "Kearney", "United States",
     40.7270, -99.0068, "America/Chicago"),
    ("IFP", "Laughlin/Bullhead International Airport", "Bullhead City", "United States",
     35.1574, -114.5595, "America/Phoenix"),
]

# Direct cost of a minute of block time, as published.
_COST_SOURCE = "https://www.airlines.org/dataset/u-s-passenger-carrier-delay-costs/"
COST_ASSUMPTIONS = [
    ("block_minute_usd", "98.41", "2025 average direct cost per block minute, all years", _COST_SOURCE),
    ("block_minute_usd_2024", "100.76", "2024 average, for sensitivity checks", _COST_SOURCE),
]

# Federal holidays. Month, then a day, or a weekday with its rank
# in the month (-1 is the last one).
HOLIDAY_RULES = [
    ("New Year's Day", 1, 1, None, None),
    ("Martin Luther King Jr. Day", 1, None, "MO", 3),
    ("Presidents' Day", 2, None, "MO", 3),
    ("Memorial Day", 5, None, "MO", -1),
    ("Juneteenth", 6, 19, None, None),
    ("Independence Day", 7, 4, None, None),
    ("Labor Day", 9, None, "MO", 1),
    ("Columbus Day", 10, None, "MO", 2),
    ("Veterans Day", 11, 11, None, None),
    ("Thanksgiving", 11, None, "TH", 4),
    ("Christmas Day", 12, 25, None, None),
]

# Days of the Thanksgiving travel window around the holiday.
THANKSGIVING_WINDOW = (-2, 4)


def one_row(spark: SparkSession) -> DataFrame:
    """A single row in a single partition, to start literal tables from."""
    return spark.range(0, 1, 1, 1)


def inline_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Literal rows as a table of known size, without a Python task."""
    fields = T.StructType.fromDDL(schema).fields
    records = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)])
        for row in rows
    ]
    return one_row(spark).select(F.inline(F.array(*records)))


def carrier_lookup(spark: SparkSession) -> DataFrame:
    return inline_table(
        spark, CARRIERS, "carrier string, carrier_name string, carrier_type string, operates_for string"
    )


def airport_overrides(spark: SparkSession) -> DataFrame:
    return inline_table(
        spark,
        AIRPORT_OVERRIDES,
        "airport_code string, airport_name string, city string, country string,"
        " latitude double, longitude double, timezone string",
    )


def cost_assumptions(spark: SparkSession) -> DataFrame:
    return inline_table(
        spark,
        COST_ASSUMPTIONS,
        "assumption string, value decimal(5,2), note string, source string",
    )


def cost_per_minute(assumptions: DataFrame, name: str) -> Column:
    """The rate as a scalar subquery."""
    return assumptions.filter(F.col("assumption") == name).select("value").scalar()


def holiday_date(year: Column, month: int, day: int | None, weekday: str | None, rank: int | None) -> Column:
    """Date of a holiday rule in a year."""
    if day is not None:
        return F.make_date(year, F.lit(month), F.lit(day))
    first = F.make_date(year, F.lit(month), F.lit(1))
    if rank == -1:
        return F.next_day(F.date_sub(F.last_day(first), 7), weekday)
    return F.date_add(F.next_day(F.date_sub(first, 1), weekday), 7 * (rank - 1))


def holidays(years: DataFrame) -> DataFrame:
    """(date_day, holiday_name) for each row of ``years`` with a year column."""
    rules = F.array(
        *[
            F.struct(
                holiday_date(F.col("year"), *rule).alias("date_day"),
                F.lit(name).alias("holiday_name"),
            )
            for name, *rule in HOLIDAY_RULES
        ]
    )
    return years.select(F.inline(rules))


def thanksgiving_periods(years: DataFrame) -> DataFrame:
    """(window_start, window_end, label) around Thanksgiving of each year."""
    before, after = THANKSGIVING_WINDOW
    day = F.col("date_day")
    return (
        holidays(years)
        .filter(F.col("holiday_name") == "Thanksgiving")
        .select(
            F.date_add(day, before).alias("window_start"),
            F.date_add(day, after).alias("window_end"),
            F.col("holiday_name").alias("label"),
        )
    )
