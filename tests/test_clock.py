import datetime as dt

import pytest
from pyspark.sql import functions as F

from flightlag.functions.clock import hhmm_hour, hhmm_to_local, local_to_instant, minutes_between

DAY = dt.date(2024, 3, 5)


def locals_of(spark, values, mode="floor"):
    df = spark.createDataFrame([(v,) for v in values], "hhmm int")
    out = df.select(hhmm_to_local(F.lit(DAY), F.col("hhmm"), mode).alias("t")).collect()
    return [r.t for r in out]


def test_hhmm_is_read_as_hours_and_minutes(spark):
    at = lambda h, m, d=5: dt.datetime(2024, 3, d, h, m)
    assert locals_of(spark, [0, 856, 850, 950, 2359, 2400, None]) == [
        at(0, 0), at(8, 56), at(8, 50), at(9, 50), at(23, 59), at(0, 0, 6), None,
    ]


def test_rounded_hours(spark):
    df = spark.createDataFrame([(856,), (850,), (950,), (2400,)], "hhmm int")
    hours = [r.h for r in df.select(hhmm_hour(F.col("hhmm"), "round").alias("h")).collect()]
    assert hours == [9, 8, 10, 24]
    assert locals_of(spark, [856], "round") == [dt.datetime(2024, 3, 5, 9, 56)]


def test_unknown_mode_is_refused():
    with pytest.raises(ValueError):
        hhmm_hour(F.lit(1), "ceil")


def offsets(spark, cases):
    """Hours the instant is ahead of the wall clock."""
    df = spark.createDataFrame(
        [(dt.datetime.fromisoformat(t), z) for t, z in cases], "t timestamp_ntz, z string"
    )
    instant = local_to_instant(F.col("t"), F.col("z"))
    ahead = (F.unix_seconds(instant) - F.unix_seconds(F.col("t").cast("timestamp"))) / 3600
    return [r.h for r in df.select(ahead.alias("h")).collect()]


def test_zones_follow_daylight_saving(spark):
    zones = ["America/Chicago", "America/Phoenix", "Pacific/Honolulu"]
    cases = [(f"2024-{m}-15 12:00", z) for z in zones for m in ("01", "07")]
    assert offsets(spark, cases) == [6, 5, 7, 7, 10, 10]


def test_skipped_and_repeated_hours(spark):
    cases = [
        ("2024-03-10 02:30", "America/Chicago"),  # skipped: read as 03:30 summer time
        ("2024-11-03 00:30", "America/Chicago"),
        ("2024-11-03 01:30", "America/Chicago"),  # shown twice: the second one
        ("2024-11-03 02:30", "America/Chicago"),
    ]
    assert offsets(spark, cases) == [6, 5, 6, 6]


def test_zone_conversion_agrees_with_sql_engine(spark):
    """Every half hour of the two change days, in several zones."""
    import duckdb

    zones = ["America/New_York", "America/Chicago", "America/Phoenix", "America/Los_Angeles"]
    times = [
        dt.datetime(2024, m, d) + dt.timedelta(minutes=30 * i)
        for m, d in ((3, 10), (11, 3))
        for i in range(48)
    ]
    cases = [(t.isoformat(" "), z) for t in times for z in zones]
    con = duckdb.connect()
    con.execute("CREATE TABLE c (n INT, t TIMESTAMP, z VARCHAR)")
    con.executemany("INSERT INTO c VALUES (?, ?, ?)", [(n, *c) for n, c in enumerate(cases)])
    expected = [
        r[0] for r in con.execute("SELECT (epoch(t AT TIME ZONE z) - epoch(t)) / 3600 FROM c ORDER BY n").fetchall()
    ]
    assert offsets(spark, cases) == expected


def test_missing_zone_gives_no_instant(spark):
    assert offsets(spark, [("2024-01-01 00:00", None)]) == [None]


def test_minutes_between_counts_boundaries(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:59' a, timestamp'2024-01-01 00:01:00' b")
    assert df.select(minutes_between(F.col("a"), F.col("b")).alias("m")).first().m == 1
    assert df.select(minutes_between(F.col("b"), F.col("a")).alias("m")).first().m == -1
