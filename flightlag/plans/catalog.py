"""Every operator and report as a query over a folder of parquet tables.

The queries run on a leg feed that Spark computes from ``events``, on an airport
file it computes from ``customer``, and on ``orders`` and ``lineitem``. Results
are given in types every engine shares, see ``portable``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightlag.functions.clock import epoch_minute, hhmm_hour
from flightlag.functions.numeric import round_to
from flightlag.operators import scorecard as sc
from flightlag.operators.benchmark import benchmark_floor
from flightlag.operators.filters import Slice
from flightlag.operators.periods import join_periods, join_windows
from flightlag.operators.quantile import exact_quantiles
from flightlag.operators.turns import flyable_legs
from flightlag.plans import analyses, dimensions, explore, exports, marts, quality
from flightlag.plans.rotation_months import MonthlyRotation, month_starts, rotation_by_days
from flightlag.plans.staging import stg_flight
from flightlag.plans.warehouse import Warehouse
from flightlag.session import pin_session, scratch_path
from flightlag.settings import Settings
from flightlag.sources import raw_feed, sinks
from flightlag.sources.airports import MISSING, read_airport_file, with_overrides, write_airport_file
from flightlag.sources.event_feed import legs_from_events, station_zones
from flightlag.sources.reference import inline_table, thanksgiving_periods
from flightlag.sources.schema import cast_text
from flightlag.streaming.landing import LANDED_FILE, Ledger

Query = Callable[[SparkSession, str], DataFrame]

# Thresholds that leave something to see on the feed.
FEED_SETTINGS = Settings(
    min_sample=120,
    route_min_flights=20,
    route_export_min_flights=40,
    opportunity_min_turns=50,
    ranking_min_flights=100,
    worst_day_min_chain=1,
    tie_break=(*Settings().tie_break, "event_id"),
)
FEED_BOUNDS = quality.Bounds(
    months=2,
    calendar_days=31,
    flights_per_year=(100, 9_000_000),
    unexplained_share=0.01,
    invalid_schedules=(0, 1_000),
    on_time_pct=(50, 90),
    correlation=0.1,
    tight_over_loose=1.01,
    dst_station="ORD",
    utc_offsets=1,
)
# A narrowed view for the filter queries: the filter is what they show.
NARROWED = Slice(carriers=("AA", "WN", "OO"), airports=("ATL", "DEN", "ORD", "HNL"))
WEEK = replace(NARROWED, date_from=dt.date(2024, 1, 8), date_to=dt.date(2024, 1, 14))


def portable(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, other numbers as doubles of six digits, dates as
    text, instants as minutes since 1970."""

    def cell(f: T.StructField) -> Column:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = round_to(c, 6)
        elif isinstance(t, T.DateType):
            c = c.cast("string")
        elif isinstance(t, T.TimestampType):
            c = epoch_minute(c)
        elif isinstance(t, T.TimestampNTZType):
            c = epoch_minute(c.cast("timestamp"))
        return c.alias(f.name)

    return df.select(*[cell(f) for f in df.schema])


# ------------------------------------------------------------------------ inputs


@dataclass
class Inputs:
    """The tables of one folder and what is computed from them once."""

    spark: SparkSession
    sf_dir: str
    settings: Settings = FEED_SETTINGS
    made: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def once(self, key: str, make: Callable[[], object]):
        if key not in self.made:
            self.made[key] = make()
        return self.made[key]

    def legs(self) -> DataFrame:
        return legs_from_events(self.table("events"), self.settings.max_rows_per_sequence)

    def warehouse(self) -> Warehouse:
        return self.once(
            "warehouse",
            lambda: Warehouse(
                self.spark,
                self.legs(),
                read_airport_file(self.spark, self.airport_file()),
                self.settings,
            ),
        )

    def airport_file(self) -> str:
        """The reference file, written once."""

        def write() -> str:
            path = scratch_path(self.spark, "airports")
            write_airport_file(self.airport_rows(), path)
            return path

        return self.once("airports", write)

    def airport_rows(self) -> DataFrame:
        """Stations of the feed and one more airport per code that customers share.

        A customer's code is its key in base 26, modulo 26^3. Two fixed rows more have
        a missing code and a code of four letters, which the reader drops.
        """
        stations = inline_table(
            self.spark, station_zones(), "airport_code string, timezone string"
        ).select(
            "airport_code",
            F.concat(F.col("airport_code"), F.lit(" Airport")).alias("airport_name"),
            F.concat(F.lit("City of "), F.col("airport_code")).alias("city"),
            F.lit("United States").alias("country"),
            (F.ascii("airport_code") / 2.0).alias("latitude"),
            (F.ascii("airport_code") * -1.5).alias("longitude"),
            "timezone",
        )
        k = F.col("c_custkey")
        digits = [F.pmod(F.floor(k / F.lit(26**n)), F.lit(26)) for n in (2, 1, 0)]
        others = (
            self.table("customer")
            .groupBy(F.concat(*[F.chr(d + 65) for d in digits]).alias("airport_code"))
            .agg(
                F.min("c_name").alias("airport_name"),
                F.min("c_mktsegment").alias("city"),
                F.concat(F.lit("NATION_"), F.min("c_nationkey")).alias("country"),
                (F.min(k % 180) - 90.0).alias("latitude"),
                (F.max(k % 360) - 180.0).alias("longitude"),
                F.max(F.when(k % 5 != 0, F.lit("America/Denver"))).alias("timezone"),
            )
        )
        dropped = inline_table(self.spark, [(MISSING, "UTC"), ("ABCD", "UTC")], "airport_code string, timezone string")
        others = others.unionByName(dropped, allowMissingColumns=True)
        return stations.unionByName(others.join(stations, "airport_code", "left_anti"))

    def text_feed(self) -> str:
        """The feed as delimited text, written once."""

        def write() -> str:
            path = scratch_path(self.spark, "text-feed")
            raw_feed.write_text_feed(self.warehouse().feed(), path)
            return path

        return self.once("text", write)

    def month_root(self) -> str:
        """The text feed typed and stored by month."""

        def write() -> str:
            path = scratch_path(self.spark, "months")
            text = raw_feed.read_text_feed(self.spark, self.text_feed())
            raw_feed.write_months(raw_feed.typed_projection(text), path)
            return path

        return self.once("months", write)

    def first_month_root(self) -> str:
        """A store that so far holds the earliest month only."""

        def write() -> str:
            path = scratch_path(self.spark, "first-month")
            feed = raw_feed.read_months(self.spark, self.month_root())
            month = F.struct("year", "month")
            first = feed.agg(F.min(month)).scalar()
            raw_feed.write_months(feed.filter(month == first), path, laid_out=True)
            return path

        return self.once("first-month", write)


_INPUTS: dict[tuple[str, str, str], Inputs] = {}


def inputs(spark: SparkSession, sf_dir: str, settings: Settings = FEED_SETTINGS) -> Inputs:
    pin_session(spark)
    key = (spark.sparkContext.applicationId, sf_dir, repr(settings))
    if key not in _INPUTS:
        _INPUTS[key] = Inputs(spark, sf_dir, settings)
    return _INPUTS[key]


# ----------------------------------------------------------------------- queries

QUERIES: dict[str, Query] = {}


def query(plan: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(plan(inputs(spark, sf_dir)))

    QUERIES[plan.__name__] = run
    return plan


def on_warehouse(name: str, plan: Callable[[Warehouse], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(plan(inputs(spark, sf_dir).warehouse()))

    QUERIES[name] = run


# -------------------------------------------------------------- sources and typing


@query
def airport_reference(x: Inputs) -> DataFrame:
    return with_overrides(read_airport_file(x.spark, x.airport_file()))


@query
def scan_csv_typed(x: Inputs) -> DataFrame:
    return raw_feed.typed_projection(raw_feed.read_text_feed(x.spark, x.text_feed()))


@query
def typed_projection(x: Inputs) -> DataFrame:
    """Cells in good and bad shape, cut from the events' own texts."""
    i, v = F.col("event_id"), F.col("value")
    texts = {
        0: F.format_string("%.2f", F.floor(v).cast("double")),
        1: F.concat(F.lit(" "), F.floor(v).cast("string"), F.lit(" ")),
        2: F.lit(""),
        3: F.col("event_type"),
        4: F.lpad(F.pmod(i, F.lit(2400)).cast("string"), 4, "0"),
        5: F.lit("   "),
    }
    text = reduce(
        lambda rest, item: F.when(i % 7 == item[0], item[1]).otherwise(rest),
        texts.items(),
        F.when(v >= 20, F.lit("1.00")).otherwise(F.lit("0.00")),
    )
    day = F.when(i % 3 == 0, F.lit("not a day")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    cells = x.table("events").select("event_id", text.alias("text"), day.alias("day"))
    return cells.select(
        "event_id",
        *[
            cast_text(F.col("text"), kind).alias(f"as_{kind}")
            for kind in ("int", "hhmm", "minutes", "num", "bool", "str")
        ],
        cast_text(F.col("day"), "date").alias("as_date"),
    )


@query
def scan_partitioned(x: Inputs) -> DataFrame:
    months = raw_feed.read_months(x.spark, x.month_root())
    return months.groupBy("year", "month").agg(
        F.count("*").alias("flights"),
        F.min("flight_date").alias("first_day"),
        F.max("flight_date").alias("last_day"),
        F.sum("arr_delay").alias("arr_delay_sum"),
        F.sum("distance_miles").alias("miles"),
    )


def _wanted_months(x: Inputs) -> DataFrame:
    """From the first month of the feed to the month after its last."""
    feed = raw_feed.read_months(x.spark, x.month_root())
    span = feed.agg(F.min("flight_date").alias("lo"), F.max("flight_date").alias("hi"))
    return span.select(raw_feed.months_between(F.col("lo"), F.add_months("hi", 1)))


@query
def months_to_ingest(x: Inputs) -> DataFrame:
    return raw_feed.month_status(
        _wanted_months(x),
        raw_feed.read_months(x.spark, x.month_root()).select("year", "month"),
        raw_feed.stored_months(x.spark, x.first_month_root()),
    )


@query
def ingest_month(x: Inputs) -> DataFrame:
    """Top up a store holding the first month; every month is there afterwards."""

    def topped_up() -> str:
        root = scratch_path(x.spark, "topped-up")
        first = raw_feed.read_months(x.spark, x.first_month_root())
        raw_feed.write_months(first, root, laid_out=True)
        typed = raw_feed.read_months(x.spark, x.month_root())
        new = raw_feed.months_to_ingest(
            _wanted_months(x),
            typed.select("year", "month"),
            raw_feed.stored_months(x.spark, x.first_month_root()),
        )
        raw_feed.ingest_new_months(typed, new, root, laid_out=True)
        return root

    return raw_feed.stored_months(x.spark, x.once("topped-up", topped_up))


@query
def landed_months(x: Inputs) -> DataFrame:
    """Files of a day each that land twice, under two names: every row is stored once."""

    def landed() -> str:
        root = scratch_path(x.spark, "landed-months")
        feed = raw_feed.read_months(x.spark, x.month_root())
        for number in range(2):
            named = feed.withColumn(LANDED_FILE, F.concat_ws("-", F.lit(number), F.col("flight_date").cast("string")))
            Ledger(x.spark, f"{root}-ledger").land(named, number, root)
        return root

    return raw_feed.stored_months(x.spark, x.once("landed-months", landed))


@query
def inline_reference(x: Inputs) -> DataFrame:
    """Inherited delay priced at every published rate."""
    wh = x.warehouse()
    minutes = wh.flight_once(instants=False).agg(F.sum("inherited_delay_minutes")).scalar()
    return wh.cost_assumptions().select(
        "assumption", "value", minutes.alias("inherited_minutes"), (minutes * F.col("value")).alias("usd")
    )


@query
def calendar(x: Inputs) -> DataFrame:
    """Calendar over the days of the orders."""
    span = x.table("orders").agg(
        F.min(F.col("o_orderdate").cast("date")).alias("first_day"),
        F.max(F.col("o_orderdate").cast("date")).alias("last_day"),
    )
    return dimensions.dim_date(dimensions.calendar(span))


@query
def range_join_periods(x: Inputs) -> DataFrame:
    """Orders per Thanksgiving window, by the window their day falls in."""
    orders = x.table("orders").select(
        F.col("o_orderdate").cast("date").alias("order_day"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )
    span = orders.agg(F.year(F.min("order_day")).alias("lo"), F.year(F.max("order_day")).alias("hi"))
    years = span.select(F.explode(F.sequence("lo", "hi")).alias("year"))
    periods = thanksgiving_periods(years).withColumn("period_year", F.year("window_start"))
    return (
        join_periods(orders, "order_day", periods, "window_start", "window_end")
        .groupBy("label", "period_year")
        .agg(F.count("*").alias("orders"), F.sum("cents").alias("cents"))
    )


# ------------------------------------------------------------------- flight facts

FLIGHT_KEY = ["event_id", "tail_number"]

on_warehouse("stg_flight", lambda wh: wh.stg_flight().select(
    "event_id", "origin", "dest", "origin_tz", "dest_tz", "sched_dep_local", "sched_dep_utc",
    "is_schedule_valid", "sched_arr_utc", "actual_dep_utc", "actual_arr_utc",
))
on_warehouse("fct_flight", lambda wh: wh.flight_once())
on_warehouse("delay_split", lambda wh: wh.flight_once(instants=False).select(
    *FLIGHT_KEY, "root_delay_minutes", "inherited_delay_minutes", "controllable_root_minutes",
    "external_root_minutes", "has_cause_attribution", "has_complete_attribution",
))
on_warehouse("primary_cause", lambda wh: wh.flight_once(instants=False).groupBy("carrier", "primary_cause").agg(
    F.count("*").alias("flights"),
    F.sum("arr_delay_minutes").alias("delay_minutes"),
))
on_warehouse("cancellation_reason", lambda wh: wh.flight_once(instants=False).groupBy(
    "cancellation_code", "cancellation_reason"
).agg(F.count("*").alias("flights")))
on_warehouse("flyable_legs", lambda wh: flyable_legs(wh.flight_once()).select(
    *FLIGHT_KEY, "origin", "dest", "sched_dep_utc", "actual_arr_utc"
))


@query
def stg_flight_rounded_clock(x: Inputs) -> DataFrame:
    """Instants and hours with the hour rounded instead of cut."""
    wh = x.warehouse()
    staged = stg_flight(wh.feed(), wh.stg_airport(), "round")
    return staged.select(
        "event_id",
        "crs_dep_time",
        hhmm_hour(F.col("crs_dep_time"), "round").alias("sched_dep_hour_local"),
        "sched_dep_utc",
        "sched_arr_utc",
    )


# -------------------------------------------------------------------- dimensions

on_warehouse("airport_activity", lambda wh: wh.airport_activity())
on_warehouse("dim_airport", lambda wh: wh.dim_airport())
on_warehouse("dim_carrier", lambda wh: wh.dim_carrier())
on_warehouse("dim_date", lambda wh: wh.dim_date())

# ---------------------------------------------------------------------- rotation

on_warehouse("leg_sequence", lambda wh: wh.rotation_links().select(
    *FLIGHT_KEY, "leg_seq", "prev_dest", "prev_carrier", "prev_flight_date", "prev_flight_number",
    "prev_origin", "prev_sched_arr_utc", "prev_actual_arr_utc", "prev_arr_delay",
    "prev_root_delay_minutes", "prev_inherited_delay_minutes", "prev_primary_cause",
))
on_warehouse("rotation_links", lambda wh: wh.rotation_links().select(
    *FLIGHT_KEY, "sched_turn_minutes", "actual_turn_minutes", "is_continuation"
))
on_warehouse("min_turn", lambda wh: wh.min_turn())
on_warehouse("turn_slack", lambda wh: wh.rotation_leg().select(
    *FLIGHT_KEY, "min_turn_minutes", "benchmark_level", "turn_slack_minutes",
    "predicted_inherited_minutes", "inherited_prediction_error",
))
on_warehouse("cascade_islands", lambda wh: wh.rotation_leg().select(
    *FLIGHT_KEY, "is_inheriting", "cascade_id", "cascade_position", "cascade_length"
))


LINKED = (
    *FLIGHT_KEY, "leg_seq", "prev_dest", "prev_carrier", "prev_flight_date", "prev_flight_number", "prev_origin",
    "prev_sched_arr_utc", "prev_actual_arr_utc", "prev_arr_delay", "prev_root_delay_minutes",
    "prev_inherited_delay_minutes", "prev_primary_cause", "sched_turn_minutes", "actual_turn_minutes", "is_continuation",
    "is_inheriting", "cascade_id", "cascade_position", "cascade_length",
)


def _kept_rotation(x: Inputs, key: str, starts: Callable[[DataFrame], list[dt.date]]) -> DataFrame:
    def add_all() -> MonthlyRotation:
        flights = x.warehouse().flight()
        return rotation_by_days(x.spark, flights, starts(flights), scratch_path(x.spark, key), x.settings)

    return x.once(key, add_all).links().select(*LINKED)


@query
def rotation_by_month(x: Inputs) -> DataFrame:
    """The rotation grown month by month: every column as in a rebuild."""
    return _kept_rotation(x, "rotation-months", month_starts)


@query
def rotation_by_ten_days(x: Inputs) -> DataFrame:
    """The same in batches of ten days."""

    def starts(flights: DataFrame) -> list[dt.date]:
        first, *_, end = month_starts(flights)
        return [*(first + dt.timedelta(days=n) for n in range(0, (end - first).days, 10)), end]

    return _kept_rotation(x, "rotation-days", starts)


@query
def min_turn_network(x: Inputs) -> DataFrame:
    """The turn floors when no group is large enough but the whole."""
    turns = x.warehouse().rotation_links().filter(
        "is_continuation AND actual_turn_minutes BETWEEN 1 AND 720"
    )
    return benchmark_floor(
        turns, "actual_turn_minutes", "carrier", "origin", min_sample=10**12
    ).withColumnRenamed("floor_value", "min_turn_minutes")


# ------------------------------------------------------------------------- marts

on_warehouse("carrier_monthly", lambda wh: wh.carrier_monthly())
on_warehouse("airport_daily", lambda wh: wh.airport_daily())
on_warehouse("route_reliability", lambda wh: wh.route_reliability())
on_warehouse("cascade", lambda wh: wh.cascade())
on_warehouse("buffer_simulation", lambda wh: wh.turn_slack_opportunity())

# ---------------------------------------------------------------------- analyses

on_warehouse("scope", lambda wh: analyses.scope(wh.flight()))
on_warehouse("inherited_share", lambda wh: analyses.inherited_share(wh.flight(), wh.cost()))
on_warehouse("model_validation", lambda wh: analyses.model_validation(wh.rotation_leg()))
on_warehouse("slack_response", lambda wh: analyses.slack_response(wh.rotation_leg()))
on_warehouse("slack_composition", lambda wh: analyses.slack_composition(
    wh.rotation_leg(), wh.settings.focus_carrier
))
on_warehouse("cascade_by_hour", lambda wh: analyses.cascade_by_hour(wh.cascade()))
on_warehouse("buffer_by_hour", lambda wh: analyses.buffer_by_hour(wh.rotation_leg()))
on_warehouse("hour_extremes", lambda wh: analyses.hour_extremes(
    analyses.cascade_by_hour(wh.cascade()), analyses.buffer_by_hour(wh.rotation_leg())
))
on_warehouse("prevention_value", lambda wh: analyses.prevention_value(
    wh.cascade(), wh.cost(), wh.settings
))
on_warehouse("carrier_ranking", lambda wh: analyses.carrier_ranking(
    wh.carrier_monthly(), wh.dim_carrier(), wh.settings.ranking_min_flights
))
on_warehouse("carrier_station_slack", lambda wh: analyses.carrier_station_slack(
    wh.turn_slack_opportunity(), wh.dim_carrier(), wh.settings.station_pairs
))
on_warehouse("event_vs_control", lambda wh: analyses.event_vs_control(
    wh.flight(), wh.settings.focus_carrier
))
on_warehouse("cascade_length", lambda wh: analyses.cascade_length(
    wh.cascade(), wh.settings.longest_reported_chain
))
on_warehouse("top_stations", lambda wh: analyses.top_stations(
    wh.turn_slack_opportunity(), wh.settings.top_station_rows, wh.settings.ranked_buffer
))


@query
def top_stations_by_5(x: Inputs) -> DataFrame:
    """The same ranking with other buffers."""
    wh, settings = x.warehouse(), replace(x.settings, ranked_buffer=5, added_buffers=(5, 20))
    ranked = marts.mart_turn_slack_opportunity(
        wh.rotation_leg(), wh.dim_airport(), wh.dim_carrier(), wh.cost(), settings
    )
    return analyses.top_stations(ranked, settings.top_station_rows, settings.ranked_buffer)


on_warehouse("monthly_trend", lambda wh: analyses.monthly_trend(wh.carrier_monthly()))
on_warehouse("turn_cutoff_sensitivity", lambda wh: analyses.turn_cutoff_sensitivity(
    wh.rotation_links()
))
on_warehouse("pilot_baseline", lambda wh: analyses.pilot_baseline(wh.flight()))
on_warehouse("difference_in_differences", lambda wh: analyses.difference_in_differences(
    wh.airport_daily(),
    F.col("airport_code").isin("ATL", "DEN", "DFW"),
    F.col("flight_date") >= F.lit("2024-01-16").cast("date"),
    "departures_delayed_pct",
))

# ----------------------------------------------------------------------- exports

on_warehouse("export_airport_daily", lambda wh: exports.export_airport_daily(
    wh.airport_daily(), wh.dim_airport()
))
on_warehouse("export_route_reliability", lambda wh: exports.export_route_reliability(
    wh.route_reliability(), wh.settings.route_export_min_flights
))
on_warehouse("export_cascade_by_hour", lambda wh: exports.export_cascade_by_hour(wh.cascade()))
on_warehouse("export_cascade_length", lambda wh: exports.export_cascade_length(wh.cascade()))
on_warehouse("export_buffer_by_hour", lambda wh: exports.export_buffer_by_hour(wh.rotation_leg()))
on_warehouse("dashboard_payload", exports.payload_rows)

# ------------------------------------------------------------------- interactive

on_warehouse("filter_domain", lambda wh: explore.filter_domain(
    wh.flight(), wh.dim_carrier(), wh.dim_airport()
))
on_warehouse("filtered_kpis", lambda wh: explore.filtered_kpis(
    wh.flight_days(), NARROWED, wh.cost()
))
on_warehouse("filtered_trend", lambda wh: explore.filtered_trend(wh.flight_days(), NARROWED))
on_warehouse("filtered_damage", lambda wh: explore.filtered_damage(wh.cascade_hours(), NARROWED))
on_warehouse("damage_vs_repair", lambda wh: explore.damage_vs_repair(
    wh.cascade_hours(), wh.turn_hours(), NARROWED
))
on_warehouse("worst_cascade_days", lambda wh: explore.worst_cascade_days(
    wh.rotation_links(), Slice(), wh.settings
))
on_warehouse("rotation_timeline", lambda wh: explore.rotation_timeline(wh.rotation_leg()))
on_warehouse("cascade_start", lambda wh: explore.cascade_start(wh.rotation_leg()))
on_warehouse("rotation_breaks", lambda wh: explore.rotation_breaks(wh.rotation_links()))
on_warehouse("filtered_damage_week", lambda wh: explore.filtered_damage(wh.cascade_hours(), WEEK))


@query
def filter_description(x: Inputs) -> DataFrame:
    """What each filter says of itself, with the flights it leaves."""
    source = x.warehouse().flight_days()
    slices = [Slice(), NARROWED, WEEK, Slice(("AA",)), Slice(date_from=WEEK.date_from)]
    rows = [
        source.figures(where, [], [sc.rows("flights")]).withColumn("shown", F.lit(where.describe())) for where in slices
    ]
    return reduce(DataFrame.unionByName, rows)


@query
def models_by_name(x: Inputs) -> DataFrame:
    """SQL over the registered models: delay handed on and what cascades made of it."""
    x.warehouse().register("named_")
    return x.spark.sql("""
        SELECT carrier, flights, inherited, cascades, downstream
        FROM (SELECT carrier, count(*) AS flights, sum(inherited_delay_minutes) AS inherited
              FROM named_fct_flight GROUP BY carrier)
        JOIN (SELECT carrier, count(*) AS cascades, sum(downstream_delay_minutes) AS downstream
              FROM named_mart_cascade GROUP BY carrier) USING (carrier)
    """)


def ranked_stations(wh: Warehouse) -> DataFrame:
    s = wh.settings
    return explore.station_opportunities(wh.turn_slack_opportunity(), NARROWED, s.opportunity_rows, s.ranked_buffer)


on_warehouse("station_opportunities", ranked_stations)
on_warehouse("station_labels", lambda wh: explore.station_labels(ranked_stations(wh)))
on_warehouse("filtered_kpis_week", lambda wh: explore.filtered_kpis(wh.flight_days(), WEEK, wh.cost()))
on_warehouse("filtered_trend_week", lambda wh: explore.filtered_trend(wh.flight_days(), WEEK))
on_warehouse("one_aircraft_day", lambda wh: explore.one_aircraft_day(
    wh.rotation_leg(), "N107", dt.date(2024, 1, 9)
).select("tail_number", "flight_date", "leg_seq", "origin", "dest", "arr_delay", "is_continuation"))
on_warehouse("event_window", lambda wh: analyses.event_vs_control(
    wh.flight(), wh.settings.focus_carrier, WEEK.date_from, WEEK.date_to
))


# ----------------------------------------------------------------------- quality

on_warehouse("dq_suite", lambda wh: quality.dq_suite(wh, FEED_BOUNDS))
on_warehouse("table_profile", quality.table_profile)
on_warehouse("build_log", lambda wh: wh.build().select("model", "rows"))


@query
def csv_file(x: Inputs) -> DataFrame:
    """The carrier report written as CSV in order and read back."""
    report, path = portable(x.warehouse().carrier_monthly()), scratch_path(x.spark, "csv")
    sinks.write_csv(report, path, ["carrier", "month_start"])
    return x.spark.read.schema(report.schema).options(header=True).csv(path)


@query
def json_file(x: Inputs) -> DataFrame:
    """A report series written into a JSON document, in order, and read back."""
    lengths = portable(analyses.cascade_length(x.warehouse().cascade()))
    meta = x.warehouse().flight().agg(F.count("*").alias("flights"))
    path = scratch_path(x.spark, "json")
    sinks.write_json_document(sinks.json_document(meta, {"lengths": (lengths, ["length"])}), path)
    record = T.StructType([T.StructField("lengths", T.ArrayType(lengths.schema)), T.StructField("meta", meta.schema)])
    read = x.spark.read.text(path).select(F.from_json("value", record).alias("d"))
    series = read.select("d.meta.flights", F.posexplode("d.lengths").alias("place", "row"))
    return series.select("flights", "place", "row.*")


# --------------------------------------------- the generic operators on other tables


@query
def scorecard_lineitem(x: Inputs) -> DataFrame:
    returned = F.col("l_returnflag") == "R"
    return sc.scorecard(
        x.table("lineitem"),
        ["l_linestatus", "l_linenumber"],
        [
            sc.rows("lines"),
            sc.distinct("suppliers", F.col("l_suppkey")),
            sc.share("returned_pct", returned, 2),
            sc.mean("avg_quantity", F.col("l_quantity"), returned, 2),
            sc.quantile("p90_quantity", F.col("l_quantity"), 0.90, returned, 1),
            sc.largest("last_ship", F.col("l_shipdate").cast("date")),
        ],
    )


@query
def benchmark_floor_lineitem(x: Inputs) -> DataFrame:
    """Low quantities per supplier and line number, widened where lines are few."""
    return benchmark_floor(
        x.table("lineitem").select(
            F.col("l_suppkey").alias("supplier"),
            F.col("l_linenumber").alias("line"),
            F.col("l_quantity").cast("int").alias("quantity"),
        ),
        "quantity",
        "supplier",
        "line",
        min_sample=90,
        level_names=("supplier_line", "supplier", "all"),
    )


@query
def exact_quantiles_lineitem(x: Inputs) -> DataFrame:
    """Prices by flag and status, exact although nearly every price differs."""
    return exact_quantiles(
        x.table("lineitem"),
        ["l_returnflag", "l_linestatus"],
        F.col("l_extendedprice"),
        {"p05": 0.05, "p50": 0.5, "p95": 0.95},
        places=2,
    )


@query
def window_join_events(x: Inputs) -> DataFrame:
    """Events of the same user in windows of minutes to years that some events open."""
    events = x.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = F.pmod(F.floor(F.col("event_id") / 10), F.lit(5)).cast("int")
    lengths = F.array(*[F.lit(s) for s in (600, 3 * 3600, 2 * 86_400, 20 * 86_400, 3 * 365 * 86_400)])
    seconds = F.get(lengths, kind)
    windows = events.filter(F.col("event_id") % 10 == 0).select(
        "user_id",
        seconds.alias("window_seconds"),
        F.col("event_id").alias("opened_by"),
        F.col("ts").alias("opens"),
        F.timestamp_seconds(F.unix_micros("ts") / 1e6 + seconds).alias("closes"),
    )
    met = join_windows(events, "ts", windows, "opens", "closes", ["user_id"])
    return met.groupBy("window_seconds").agg(
        F.count("*").alias("pairs"), F.count_distinct("opened_by").alias("windows"), F.sum("event_id").alias("id_sum")
    )
