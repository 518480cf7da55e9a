import calendar as cal
import datetime as dt

import pytest
from pyspark.sql import functions as F

from flightlag.operators.periods import join_periods
from flightlag.plans import dimensions
from flightlag.plans.staging import stg_flight
from flightlag.sources.reference import carrier_lookup, cost_assumptions, cost_per_minute


@pytest.fixture(scope="module")
def days(spark):
    span = spark.sql("SELECT date'2021-01-01' AS first_day, date'2025-12-31' AS last_day")
    return {r.date_day: r for r in dimensions.dim_date(dimensions.calendar(span)).collect()}


def nth(year, month, weekday, n):
    found = [d for d in cal.Calendar().itermonthdates(year, month) if d.month == month and d.weekday() == weekday]
    return found[n]


def test_holidays_of_five_years(days):
    want = {}
    for y in range(2021, 2026):
        want |= {
            dt.date(y, 1, 1): "New Year's Day",
            nth(y, 1, 0, 2): "Martin Luther King Jr. Day",
            nth(y, 2, 0, 2): "Presidents' Day",
            nth(y, 5, 0, -1): "Memorial Day",
            dt.date(y, 6, 19): "Juneteenth",
            dt.date(y, 7, 4): "Independence Day",
            nth(y, 9, 0, 0): "Labor Day",
            nth(y, 10, 0, 1): "Columbus Day",
            dt.date(y, 11, 11): "Veterans Day",
            nth(y, 11, 3, 3): "Thanksgiving",
            dt.date(y, 12, 25): "Christmas Day",
        }
    assert {d: r.holiday_name for d, r in days.items() if r.is_federal_holiday} == want
    assert len(want) == 55 and len(days) == 1826


@pytest.mark.parametrize(
    "day, period",
    [
        ("2024-05-30", "Summer peak"), ("2024-05-31", "Summer peak"),
        ("2023-05-30", None), ("2023-05-31", "Summer peak"),
        ("2024-09-05", "Summer peak"), ("2024-09-06", None),
        ("2023-09-06", "Summer peak"), ("2023-09-07", None),
        ("2025-11-24", None), ("2025-11-25", "Thanksgiving"), ("2025-12-01", "Thanksgiving"), ("2025-12-02", None),
        ("2024-12-02", "Thanksgiving"), ("2024-12-19", None), ("2024-12-20", "Christmas / New Year"),
        ("2024-01-03", "Christmas / New Year"), ("2024-01-04", None),
    ],
)
def test_travel_periods(days, day, period):
    assert days[dt.date.fromisoformat(day)].travel_period == period


def test_calendar_attributes(days):
    r = days[dt.date(2024, 2, 29)]
    assert (r.year, r.quarter, r.month, r.month_name, r.day_of_month) == (2024, 1, 2, "February", 29)
    assert (r.iso_day_of_week, r.day_name, r.is_weekend) == (4, "Thursday", False)
    assert days[dt.date(2024, 3, 2)].is_weekend


def test_overlapping_periods_give_a_row_each(spark):
    df = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-01-05')) AS day")
    periods = spark.sql(
        "SELECT * FROM VALUES (date'2024-01-02', date'2024-01-03', 'a'), (date'2024-01-03', date'2024-01-03', 'b')"
        " AS t(s, e, label)"
    )
    got = sorted((r.day.day, r.label or "") for r in join_periods(df, "day", periods, "s", "e").collect())
    assert got == [(1, ""), (2, "a"), (3, "a"), (3, "b"), (4, ""), (5, "")]


def test_airports_seen_on_one_side_only(spark):
    legs = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C")], "origin string, dest string")
    activity = dimensions.airport_activity(legs)
    assert {(r.airport_code, r.departures, r.arrivals) for r in activity.collect()} == {
        ("A", 2, 0), ("B", 1, 1), ("C", 0, 2),
    }
    known = spark.createDataFrame(
        [("A", "Airport A", "Town", "Land", 1.0, 2.0, "America/Denver")],
        "airport_code string, airport_name string, city string, country string, latitude double,"
        " longitude double, timezone string",
    )
    got = {r.airport_code: r for r in dimensions.dim_airport(activity, known).collect()}
    assert got["A"].is_mapped and not got["B"].is_mapped and got["B"].timezone is None
    assert got["A"].departure_share == pytest.approx(2 / 3) and got["C"].size_band == "Non-hub"


def test_unknown_carriers_are_named(spark):
    legs = spark.sql(
        "SELECT * FROM VALUES ('AA', date'2024-01-02'), ('AA', date'2024-01-01'), ('??', date'2024-01-05')"
        " AS t(carrier, flight_date)"
    )
    got = {r.carrier: r for r in dimensions.dim_carrier(legs).collect()}
    assert (got["??"].carrier_name, got["??"].carrier_type, got["??"].is_mapped) == ("UNKNOWN (??)", "Unknown", False)
    assert (got["AA"].flights, got["AA"].first_seen) == (2, dt.date(2024, 1, 1))
    assert carrier_lookup(spark).count() == 28


def test_cost_rates(spark):
    rate = cost_per_minute(cost_assumptions(spark), "block_minute_usd")
    assert float(spark.range(1).select(rate.alias("v")).first().v) == 98.41


def test_instants_only_where_they_can_be_known(spark):
    schema = (
        "id int, flight_date date, crs_dep_time int, origin string, dest string, crs_elapsed_time int,"
        " dep_delay int, arr_delay int, cancelled boolean, diverted boolean"
    )
    day = dt.date(2024, 1, 10)
    legs = spark.createDataFrame(
        [
            (1, day, 1200, "ORD", "PHX", 60, 5, 7, False, False),
            (2, day, 1200, "ORD", "PHX", -30, 5, 7, False, False),
            (3, day, 1200, "ORD", "PHX", None, 5, 7, False, False),
            (4, day, 1200, "ORD", "PHX", 60, None, None, True, False),
            (5, day, 1200, "ORD", "PHX", 60, 5, None, False, True),
            (6, day, 1200, "???", "PHX", 60, 5, 7, False, False),
        ],
        schema,
    )
    zones = spark.createDataFrame(
        [("ORD", "America/Chicago"), ("PHX", "America/Phoenix")], "airport_code string, timezone string"
    )
    minute = lambda c: F.floor((F.unix_seconds(c) - F.unix_seconds(F.lit("2024-01-10 18:00:00").cast("timestamp"))) / 60)
    got = {
        r.id: (r.is_schedule_valid, r.d, r.a, r.ad, r.aa)
        for r in stg_flight(legs, zones)
        .select(
            "id", "is_schedule_valid", minute("sched_dep_utc").alias("d"), minute("sched_arr_utc").alias("a"),
            minute("actual_dep_utc").alias("ad"), minute("actual_arr_utc").alias("aa"),
        )
        .collect()
    }
    assert got == {
        1: (True, 0, 60, 5, 67),
        2: (False, 0, None, 5, None),
        3: (None, 0, None, 5, None),
        4: (True, 0, 60, None, None),
        5: (True, 0, 60, 5, None),
        6: (True, None, None, None, None),
    }


def test_offset_table_agrees_with_direct_conversion(spark):
    """Every quarter of an hour around both clock changes, in several zones."""
    zones = spark.createDataFrame(
        [("A", "America/Chicago"), ("B", "America/Phoenix"), ("C", "America/New_York"), ("D", None),
         ("E", "America/Santiago")],
        "airport_code string, timezone string",
    )
    days = [dt.date(2024, m, d) for m, ds in ((3, (9, 10, 11)), (4, (6, 7, 8)), (9, (7, 8, 9)), (11, (2, 3, 4))) for d in ds]
    rows = [
        (n, day, hour * 100 + minute, code, "B", 60, 0, 0, False, False)
        for n, (day, hour, minute, code) in enumerate(
            (day, h, m, c) for day in days for h in range(25) for m in (0, 15, 30, 59) for c in "ABCDE"
        )
    ]
    legs = spark.createDataFrame(
        rows,
        "id int, flight_date date, crs_dep_time int, origin string, dest string, crs_elapsed_time int,"
        " dep_delay int, arr_delay int, cancelled boolean, diverted boolean",
    )
    from flightlag.plans.staging import zone_offsets

    first, last = (F.lit(d) for d in (min(days), max(days) + dt.timedelta(days=2)))
    table = zone_offsets(zones, first, last)
    for clock in ("floor", "round"):
        direct = stg_flight(legs, zones, clock).select("id", "sched_dep_utc", "sched_arr_utc")
        through = stg_flight(legs, zones, clock, table).select("id", "sched_dep_utc", "sched_arr_utc")
        assert direct.exceptAll(through).isEmpty() and through.exceptAll(direct).isEmpty()
    changes = {(r.zone, str(r.day)): r.changes_at for r in table.filter("changes_at IS NOT NULL").collect()}
    assert changes[("America/Chicago", "2024-03-10")] == 180
    assert changes[("America/Chicago", "2024-11-03")] == 60
    assert not any(z == "America/Phoenix" for z, _ in changes)
