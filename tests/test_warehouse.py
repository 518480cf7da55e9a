"""The whole chain of models: plans, skew, exports, checks."""

import dataclasses
import glob
import json
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from flightlag import Settings, Warehouse
from flightlag.functions.numeric import ratio
from flightlag.operators.cascades import roll_up_islands
from flightlag.operators.checks import Check, Groups, equal, no_group, none, run_checks
from flightlag.operators.filters import Slice
from flightlag.plans import catalog, explore, exports, facts, marts, quality
from flightlag.plans.catalog import FEED_SETTINGS, Inputs, inputs
from flightlag.sources.airports import read_airport_file
from flightlag.sources.event_feed import legs_from_events
from flightlag.sources.tables import folder_exists


@pytest.fixture(scope="module")
def wh(spark, sf_dir):
    house = inputs(spark, sf_dir).warehouse()
    house.build()
    return house


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return len(re.findall(r"Exchange (?:hash|range|Single|RoundRobin)", plan(df)))


# -------------------------------------------------------------------------- plans


@pytest.mark.parametrize("name", sorted(entry_module.QUERIES))
def test_no_query_crosses_rows_or_runs_python(spark, sf_dir, wh, name):
    text = plan(entry_module.QUERIES[name](spark, sf_dir))
    for bad in ("CartesianProduct", "NestedLoop", "PythonUDF", "EvalPython", "ExistingRDD", "MapInPandas"):
        assert bad not in text


def test_rotation_needs_one_exchange(wh):
    """As it runs: without a long aircraft nothing is left of cutting and carrying."""
    links = facts.rotation_links(wh.flight(), wh.settings, wh.rotation_cuts())
    links.collect()
    ran = plan(links).split("== Initial Plan ==")[0]
    assert len(re.findall(r"Exchange hash", ran)) == 1 and "Join" not in ran
    assert shuffles(facts.fct_rotation_leg(wh.rotation_links(), wh.min_turn())) == 0


def test_flight_fact_is_row_wise(wh):
    assert shuffles(facts.fct_flight(wh.stg_flight(), wh.settings)) == 0


def test_scorecards_read_only_their_columns(wh):
    text = plan(marts.mart_carrier_monthly(wh.flight(), wh.dim_carrier()))
    read = re.search(r"ReadSchema: struct<([^>]*)>", text) or re.search(r"FileScan parquet \[([^\]]*)\]", text)
    assert "tail_number" not in read.group(1) and "taxi_out" not in read.group(1)


def test_dates_prune_months(wh):
    import datetime as dt

    where = Slice(date_from=dt.date(2024, 1, 1), date_to=dt.date(2024, 1, 9))
    assert "PartitionFilters: [isnotnull(year" in plan(where.apply(wh.flight()))
    day = explore.one_aircraft_day(wh.rotation_leg(), "N105", dt.date(2024, 1, 5))
    assert "PartitionFilters: [isnotnull(year" in plan(day) and "EqualTo(tail_number,N105)" in plan(day)


# --------------------------------------------------------------------------- skew


def build(spark, events, airports, max_rows):
    settings = dataclasses.replace(FEED_SETTINGS, max_rows_per_sequence=max_rows)
    return Warehouse(spark, legs_from_events(events, max_rows), airports, settings)


def same(a, b):
    columns = sorted(a.columns)
    a, b = a.select(columns), b.select(columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_hot_aircraft_gives_the_same_tables(spark, sf_dir):
    """A third of all legs flown by one aircraft, whole against cut."""
    x = inputs(spark, sf_dir)
    events = x.table("events").withColumn(
        "user_id", F.when(F.col("event_id") % 3 == 0, F.lit(7)).otherwise(F.col("user_id"))
    )
    airports = read_airport_file(spark, x.airport_file())
    whole, cut = (build(spark, events, airports, n) for n in (10**6, 25))
    assert same(whole.feed(), cut.feed())
    assert same(whole.rotation_leg(), cut.rotation_leg())
    assert same(whole.cascade(), cut.cascade())
    for view in (explore.rotation_timeline, explore.cascade_start):
        assert same(view(whole.rotation_leg()), view(cut.rotation_leg()))


# ------------------------------------------------------------------------ building


def test_a_stored_feed_is_read_where_it_lies(spark, sf_dir):
    x = inputs(spark, sf_dir)
    settings = dataclasses.replace(FEED_SETTINGS, tie_break=Settings().tie_break)
    wh = Warehouse(spark, x.month_root(), read_airport_file(spark, x.airport_file()), settings)
    wh.zone_offsets()
    staged = plan(wh.stg_flight())
    assert "Exchange hashpartitioning" not in staged and x.month_root() in staged
    wh.materialise()
    assert not folder_exists(spark, wh.store.path("feed")) and folder_exists(spark, wh.store.path("fct_flight"))
    wh.close()
    assert not folder_exists(spark, wh.store.root) and folder_exists(spark, x.month_root())


ONE_READING = ["cancellation_reason", "primary_cause", "delay_split", "inline_reference"]


def test_one_reading_of_the_fact_stores_neither_fact_nor_feed(spark, sf_dir, wh, monkeypatch):
    stored = {name: entry_module.QUERIES[name](spark, sf_dir) for name in ONE_READING}
    assert all("fct_flight" in str(stored[name].inputFiles()) for name in ONE_READING if name != "inline_reference")
    monkeypatch.setattr(catalog, "_INPUTS", {})
    for name in ONE_READING:
        assert same(entry_module.QUERIES[name](spark, sf_dir), stored[name])
    fresh = inputs(spark, sf_dir).warehouse()
    assert fresh is not wh and not fresh.store.has("feed") and not fresh.store.has("fct_flight")


def test_the_fact_is_the_same_as_stored_and_as_read(spark, sf_dir, wh):
    """Codes that the airport file repeats repeat legs either way."""
    x = inputs(spark, sf_dir)
    airports = read_airport_file(spark, x.airport_file())
    for rows in (airports, airports.unionByName(airports.filter("airport_code = 'DEN'"))):
        house = Warehouse(spark, x.legs(), rows, FEED_SETTINGS)
        plain = house.flight_once(instants=False)
        assert not house.store.has("feed")
        read = house.flight_once()
        assert not house.store.has("fct_flight") and same(plain, read)
        assert same(read, house.flight()) and "fct_flight" in str(house.flight_once(instants=False).inputFiles())
    assert house.row_count("fct_flight") > wh.row_count("fct_flight")


def test_cascades_take_one_scan_and_one_shuffle(wh):
    text = plan(roll_up_islands(wh.rotation_links(), F.lit(98.41)))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1 and "Join" not in text


def test_other_buffers(spark, wh):
    settings = dataclasses.replace(FEED_SETTINGS, ranked_buffer=5, added_buffers=(5, 20), opportunity_min_turns=3)
    stations = marts.mart_turn_slack_opportunity(
        wh.rotation_leg(), wh.dim_airport(), wh.dim_carrier(), wh.cost(), settings
    )
    assert explore.station_opportunities(stations, Slice(), 40, 5).count() > 0
    assert explore.station_labels(explore.station_opportunities(stations, Slice(), 40, 5), 3).count() == 3


def test_every_customer_counts(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    keys = spark.range(17_570, 17_590).select(
        F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit("m").alias("c_mktsegment")
    )
    x.table = lambda name: keys
    codes = {r.airport_code for r in x.airport_rows().collect()}
    assert {"ZZU", "ZZZ", "AAA", "AAN"} <= codes and {"\\N", "ABCD"} <= codes


def test_build_log(wh):
    log = {r.model: r.rows for r in wh.build().collect()}
    assert len(log) == 15
    assert log["stg_flight"] == log["fct_flight"] == 1000
    assert (log["fct_rotation_leg"], log["mart_cascade"], log["ref_cost_assumption"]) == (976, 339, 2)


def test_models_can_be_queried_by_name(spark, wh):
    wh.register("t_")
    total = spark.sql("SELECT sum(downstream_delay_minutes) AS m FROM t_mart_cascade").first().m
    assert total == wh.cascade().agg(F.sum("downstream_delay_minutes")).first()[0]


def test_default_thresholds_leave_small_groups_out(spark, wh):
    assert Settings().route_min_flights == 500
    assert marts.mart_route_reliability(wh.flight(), wh.dim_airport(), wh.dim_carrier()).count() == 0


# ------------------------------------------------------------------ exports, checks


def test_exports(spark, wh, tmp_path):
    exports.write_exports(wh, str(tmp_path))
    names = sorted(p.rsplit("/", 1)[1] for p in glob.glob(str(tmp_path / "*")))
    assert len(names) == 10
    hourly = glob.glob(str(tmp_path / "cascade_by_hour/*.csv"))
    assert len(hourly) == 1
    lines = open(hourly[0]).read().splitlines()
    assert lines[0].startswith("dep_hour,carrier,carrier_name,carrier_type,root_delays")
    hours = [int(line.split(",")[0]) for line in lines[1:]]
    assert hours == sorted(hours)
    back = spark.read.csv(str(tmp_path / "airport_daily"), header=True)
    assert back.count() == exports.export_airport_daily(wh.airport_daily(), wh.dim_airport()).count()


def test_payload_document(wh):
    doc = json.loads(exports.payload_document(wh).first().value)
    assert doc["meta"]["flights"] == 1000 and doc["meta"]["block_minute_usd"] == 98.41
    assert set(doc) == {
        "meta", "cascade_by_hour", "buffer_by_hour", "slack_response", "cascade_length", "carriers", "stations",
        "event", "monthly",
    }
    hours = [r["hour"] for r in doc["cascade_by_hour"]]
    assert hours == sorted(hours) and len(hours) <= 18
    a14 = [r["a14"] for r in doc["carriers"]]
    assert a14 == sorted(a14, reverse=True)


def test_checks_report_what_fails(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    got = {
        r.check_name: (r.observed, r.bound, r.passed)
        for r in run_checks(
            df,
            [
                none("no_twos", F.col("x") == 2),
                none("no_threes", F.col("x") == 3),
                equal("three_rows", F.count("*"), 3),
                Check("mean_in_band", F.avg("x"), 1, 1.5),
                Check("mean_may_touch", F.avg("x"), 1, 1.5, strict=False),
                Check("unknown", F.avg(F.when(F.col("x") > 9, F.col("x"))), low=0),
            ],
        ).collect()
    }
    assert got == {
        "no_twos": (1.0, "= 0", False),
        "no_threes": (0.0, "= 0", True),
        "three_rows": (3.0, "= 3", True),
        "mean_in_band": (1.5, "> 1 and < 1.5", False),
        "mean_may_touch": (1.5, ">= 1 and <= 1.5", True),
        "unknown": (None, "> 0", False),
    }


def test_suite_has_every_check(wh):
    rows = quality.dq_suite(wh).collect()
    assert len({r.check_name for r in rows}) == len(rows) == 32


def test_suite_reads_each_table_once(wh):
    """The rotation fact is a view of two tables; the others are one each."""
    suite = quality.dq_suite(wh)
    tables = {re.search(r"/(\w+)/data-", file)[1] for file in suite.inputFiles()}
    assert plan(suite).count("FileScan") == len(tables) == 11
    for checks in (quality.flight_checks(wh.flight()), quality.rotation_checks(wh.rotation_leg())):
        assert plan(checks).count("Exchange hash") == 1


def group_checks():
    key = [F.col("a"), F.col("b")]
    return [
        equal("rows", F.count("*"), 3),
        Check("pairs", groups=Groups(key)),
        Check("pairs_and_none", groups=Groups(key, nulls=True)),
        no_group("repeated", Groups(key, counted=lambda n: n > 1, nulls=True)),
        Check("odd_pairs", groups=Groups(key, where=F.col("x") % 2 == 1)),
        Check("odd_alone", groups=Groups(key, where=F.col("x") % 2 == 1, counted=lambda n: n == 1, nulls=True)),
        Check("rows_per_a", F.count("*"), groups=Groups([F.col("a")]), combined=ratio),
        Check("total", F.sum("x")),
    ]


def test_groups_are_counted_with_the_whole(spark):
    rows = [("p", "q", 1), ("p", "q", 3), ("p", None, 5), (None, None, 7), (None, None, 8), ("r", "q", 2)]
    df = spark.createDataFrame(rows, "a string, b string, x int")
    got = {r.check_name: r.observed for r in run_checks(df, group_checks()).collect()}
    assert got == {
        "rows": 6.0, "pairs": 3.0, "pairs_and_none": 4.0, "repeated": 2.0, "odd_pairs": 2.0, "odd_alone": 2.0,
        "rows_per_a": 3.0, "total": 26.0,
    }


def test_groups_of_an_empty_table(spark):
    got = run_checks(spark.createDataFrame([], "a string, b string, x int"), group_checks()).collect()
    seen = {r.check_name: (r.observed, r.passed) for r in got}
    assert seen["rows"] == (0.0, False) and seen["repeated"] == (0.0, True) and seen["pairs"][0] == 0.0
    assert seen["total"][0] is None and seen["rows_per_a"][0] is None


def test_a_hot_group_is_combined_before_the_exchange(spark):
    """A third of the rows have one key: a task sends one row for them."""
    df = spark.range(0, 30_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("x")
    )
    checks = [Check("keys", groups=Groups([F.col("k")])), Check("total", F.sum("x"))]
    out = run_checks(df, checks)
    assert [r.observed for r in out.collect()] == [20_001.0, 449_985_000.0]
    text = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "HashAggregate" in text and "SortAggregate" not in text and "ObjectHash" not in text
