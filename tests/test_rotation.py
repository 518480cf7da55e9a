import datetime as dt

import pytest
from pyspark.sql import functions as F

from flightlag.operators.benchmark import benchmark_floor
from flightlag.operators.buffer import buffer_curve, simulate_buffer
from flightlag.operators.cascades import roll_up_islands
from flightlag.operators.propagation import propagate
from flightlag.operators.turns import flyable_legs, link_turns, real_tail
from flightlag.plans.catalog import inputs
from flightlag.plans.facts import BESIDE, SAME_WHEN_FLOWN, rotation_links

LINK = (
    "origin string, prev_dest string, sched_dep_utc timestamp, prev_sched_arr_utc timestamp,"
    " actual_dep_utc timestamp, prev_actual_arr_utc timestamp"
)
T = dt.datetime(2024, 1, 1, 12)


def test_registrations(spark):
    tails = ["N1", "N12", "N123AA", "N123AAA", "UNKNOW", "000000", "N123AA\n", None, "xN12"]
    df = spark.createDataFrame([(t,) for t in tails], "t string")
    got = [r.ok for r in df.select(real_tail(F.col("t")).alias("ok")).collect()]
    assert got == [False, True, True, False, False, False, False, False, False]


def test_links(spark):
    minutes = lambda n: T + dt.timedelta(minutes=n)
    rows = [
        ("ORD", "DEN", minutes(60), T, minutes(60), T),
        *[("ORD", "ORD", minutes(n), T, minutes(n), T) for n in (-1, 0, 720, 721)],
        ("ORD", None, T, None, T, None),
    ]
    out = link_turns(spark.createDataFrame(rows, LINK)).collect()
    assert [r.is_continuation for r in out] == [False, False, True, True, False, False]
    assert [r.sched_turn_minutes for r in out] == [60, -1, 0, 720, 721, None]


def test_slack(spark):
    schema = (
        "id int, carrier string, origin string, sched_turn_minutes long, prev_arr_delay int,"
        " is_continuation boolean, inherited_delay_minutes int"
    )
    legs = spark.createDataFrame(
        [
            (1, "AA", "ORD", 60, 40, True, 30),
            (2, "AA", "XXX", 60, 40, True, 30),  # no floor known
            (3, "AA", "ORD", None, None, False, 0),  # first leg
            (4, "AA", "ORD", 30, 40, True, 0),  # planned below the floor
            (5, "AA", "ORD", 60, -5, True, 0),
            (6, "AA", "ORD", 60, 10, True, 0),
        ],
        schema,
    )
    floors = spark.createDataFrame(
        [("AA", "ORD", 45.0, "carrier")],
        "carrier string, airport string, min_turn_minutes double, benchmark_level string",
    )
    got = {
        r.id: (r.turn_slack_minutes, r.predicted_inherited_minutes, r.inherited_prediction_error)
        for r in propagate(legs, floors).collect()
    }
    assert got == {
        1: (15.0, 25.0, 5.0),
        2: (0.0, 40.0, -10.0),
        3: (0.0, 0.0, 0.0),
        4: (0.0, 40.0, -40.0),
        5: (15.0, 0.0, 0.0),
        6: (15.0, 0.0, 0.0),
    }
    with_default = {r.id: r.turn_slack_minutes for r in propagate(legs, floors, F.lit(50.0)).collect()}
    assert (with_default[1], with_default[2], with_default[3]) == (15.0, 10.0, 0.0)


def test_benchmark_levels(spark):
    rows = [("A", "X", 10 + i % 3) for i in range(100)]
    rows += [("A", "Y", 50) for _ in range(99)]
    rows += [("B", "X", 80) for _ in range(60)] + [("B", "Y", 90) for _ in range(39)]
    df = spark.createDataFrame(rows, "c string, s string, m int").repartition(5)
    out = benchmark_floor(df, "m", "c", "s", 0.05, 100).collect()
    got = {(r.c, r.s): (r.sample_size, r.floor_value, r.benchmark_level) for r in out}
    assert got == {
        ("A", "X"): (100, 10.0, "carrier_airport"),
        ("A", "Y"): (99, 10.0, "carrier"),
        ("B", "X"): (60, 10.0, "network"),
        ("B", "Y"): (39, 10.0, "network"),
    }


def test_benchmark_interpolates(spark):
    df = spark.createDataFrame([("A", "X", m) for m in (10, 20, 30)], "c string, s string, m int")
    assert benchmark_floor(df, "m", "c", "s", 0.05, 1).first().floor_value == pytest.approx(11.0, abs=1e-9)


TURNS = (
    "carrier string, origin string, prev_arr_delay int, turn_slack_minutes double, is_continuation boolean,"
    " sched_turn_minutes long, min_turn_minutes double, inherited_delay_minutes int, benchmark_level string"
)


def turns(spark):
    rows = [("AA", "ORD", i, float(s), True, 60 + s, 60.0, 5, "carrier") for i, s in ((30, 10), (5, 10), (20, 15))]
    rows += [("AA", "ORD", 99, 0.0, False, None, None, 0, None)]
    return spark.createDataFrame(rows, TURNS)


def test_buffer(spark):
    r = simulate_buffer(turns(spark), F.lit(2.0), min_turns=3).first()
    assert (r.turns, r.minutes_saved_plus_5, r.minutes_saved_plus_10, r.minutes_saved_plus_15) == (3, 10.0, 15.0, 20.0)
    assert r.efficiency_plus_10 == 0.5 and r.delay_cost_avoided_usd_plus_10 == 30.0
    assert (r.median_slack_minutes, r.tight_turn_pct, r.actual_inherited_minutes) == (10.0, 66.7, 15)
    assert simulate_buffer(turns(spark), F.lit(2.0), min_turns=4).count() == 0


def test_buffer_curve(spark):
    r = buffer_curve(turns(spark), ["carrier"], 10).first()
    assert (r.predicted_base, r.predicted_with_buffer, r.efficiency) == (25.0, 10.0, 0.5)


def test_roll_up(spark):
    schema = (
        "tail_number string, cascade_id long, cascade_position long, carrier string, flight_date date, origin string,"
        " dest string, sched_dep_utc timestamp, sched_dep_hour_local int, arr_delay int, root_delay_minutes int,"
        " inherited_delay_minutes int, controllable_root_minutes int, external_root_minutes int, primary_cause string"
    )

    def leg(tail, cascade, place, dest, root, inherited):
        return (tail, cascade, place, "AA", T.date(), "ORD", dest, T, 12, root, root, inherited, root, 0, "Carrier")

    legs = spark.createDataFrame(
        [
            leg("N1A", 1, 0, "DEN", 20, 0),
            leg("N1A", 1, 1, "ATL", 0, 20),
            leg("N1A", 1, 2, "DEN", 0, 5),
            leg("N1A", 1, 3, "ATL", 0, 3),
            leg("N1A", 2, 0, "LAX", 7, 0),  # ends where it started
            leg("N2A", 1, 0, "LAX", 0, 0),  # no root delay: left out with what follows
            leg("N2A", 1, 1, "LAX", 0, 9),
        ],
        schema,
    )
    got = {
        (r.tail_number, r.cascade_id): (
            r.downstream_legs, r.downstream_delay_minutes, r.downstream_stations_touched,
            r.total_cascade_minutes, r.amplification_ratio, float(r.total_cascade_cost_usd),
        )
        for r in roll_up_islands(legs, F.lit("98.41").cast("decimal(5,2)")).collect()
    }
    assert got == {
        ("N1A", 1): (3, 28, 2, 48, 2.4, 4723.68),
        ("N1A", 2): (0, 0, 0, 7, 1.0, 688.87),
    }


def test_windows_carry_what_they_do_not_use_in_one_column(spark, sf_dir):
    wh = inputs(spark, sf_dir).warehouse()
    flights = wh.flight()
    links = rotation_links(flights, wh.settings, wh.rotation_cuts())
    assert f"AS {BESIDE}" in links._jdf.queryExecution().optimizedPlan().toString()
    own = [c for c in flights.columns if c not in (*SAME_WHEN_FLOWN, "tail_number")]
    assert links.columns[: len(own) + 1] == ["tail_number", *own]
    legs = flyable_legs(flights).select("tail_number", *own)
    assert links.select(*legs.columns).exceptAll(legs).isEmpty() and links.count() == legs.count()
