"""Interactive questions as DataFrames: one filter, many views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from flightlag.functions.clock import month_first
from flightlag.functions.numeric import percent
from flightlag.operators import scorecard as sc
from flightlag.operators.buffer import curve_measures, with_efficiency
from flightlag.operators.filters import Slice
from flightlag.operators.summary import Source
from flightlag.settings import Settings

AIRCRAFT_DAY = ["tail_number", "flight_date"]


def filter_domain(flights: DataFrame, carriers: DataFrame, airports: DataFrame) -> DataFrame:
    """What can be picked: carriers, airports of some size, and the date span."""
    span = flights.agg(F.min("flight_date").alias("lo"), F.max("flight_date").alias("hi"))
    text = "string"
    return (
        carriers.select(
            F.lit("carrier").alias("kind"),
            F.col("carrier").alias("code"),
            F.col("carrier_name").alias("label"),
            F.col("carrier_type").alias("detail"),
            F.col("flights").alias("volume"),
        )
        .unionByName(
            airports.filter(F.col("size_band").isin("Large", "Medium", "Small")).select(
                F.lit("airport").alias("kind"),
                F.col("airport_code").alias("code"),
                F.col("city").alias("label"),
                F.col("size_band").alias("detail"),
                F.col("departures").alias("volume"),
            )
        )
        .unionByName(
            span.select(
                F.lit("span").alias("kind"),
                F.lit("flight_date").alias("code"),
                F.col("lo").cast(text).alias("label"),
                F.col("hi").cast(text).alias("detail"),
                F.lit(None).cast("long").alias("volume"),
            )
        )
    )


def kpi_measures() -> list[sc.Measure]:
    done = F.col("completed")
    return [
        sc.rows("flights"),
        sc.share("a14_pct", F.col("is_on_time_a14")),
        sc.share("completion_pct", done),
        sc.share("cancellation_pct", F.col("cancelled")),
        sc.mean("mean_arr_delay", F.col("arr_delay"), done),
        sc.quantile("p90_arr_delay", F.col("arr_delay"), 0.90, done),
        sc.total("root_minutes", F.col("root_delay_minutes")),
        sc.total("inherited_minutes", F.col("inherited_delay_minutes")),
    ]


def damage_measures() -> list[sc.Measure]:
    return [
        sc.rows("roots"),
        sc.mean("legs", F.col("downstream_legs")),
        sc.mean("minutes", F.col("downstream_delay_minutes")),
        sc.mean("amplification", F.col("amplification_ratio"), places=2),
    ]


def as_source(rows: DataFrame | Source, airport: str = "origin") -> Source:
    return rows if isinstance(rows, Source) else Source(lambda: rows, airport=airport)


def filtered_kpis(flights: DataFrame | Source, where: Slice, cost: Column) -> DataFrame:
    """The headline row of a slice with its delay split and cost."""
    figures = as_source(flights).figures(where, [], kpi_measures())
    root, inherited = F.col("root_minutes"), F.col("inherited_minutes")
    return figures.withColumns(
        {
            "inherited_pct": percent(inherited, root + inherited),
            "inherited_cost_usd": (inherited * cost).cast("decimal(38,2)"),
        }
    )


def filtered_trend(flights: DataFrame | Source, where: Slice) -> DataFrame:
    """Exact on-time rate and inherited share by month, from flights."""
    figures = as_source(flights).figures(
        where,
        ["year", "month"],
        [
            sc.share("a14_pct", F.col("is_on_time_a14")),
            sc.total("_root", F.col("root_delay_minutes")),
            sc.total("_inherited", F.col("inherited_delay_minutes")),
        ],
    )
    return figures.select(
        month_first(F.col("year"), F.col("month")).alias("month_start"),
        "a14_pct",
        percent(F.col("_inherited"), F.col("_root") + F.col("_inherited")).alias("inherited_pct"),
    )


def roots_by_hour(cascades: DataFrame) -> DataFrame:
    return cascades.withColumnRenamed("root_dep_hour_local", "hour")


def turns_by_hour(legs: DataFrame) -> DataFrame:
    return legs.filter("is_continuation").withColumnRenamed("sched_dep_hour_local", "hour")


def filtered_damage(cascades: DataFrame | Source, where: Slice, first: int = 5, last: int = 22) -> DataFrame:
    """Damage by hour; the airport filter looks at where the root departed."""
    if isinstance(cascades, DataFrame):
        cascades = as_source(roots_by_hour(cascades), "root_origin")
    return cascades.figures(where, ["hour"], damage_measures(), (first, last))


def filtered_repair(
    legs: DataFrame | Source, where: Slice, added: int = 10, first: int = 5, last: int = 22
) -> DataFrame:
    if isinstance(legs, DataFrame):
        legs = as_source(turns_by_hour(legs))
    curve = with_efficiency(legs.figures(where, ["hour"], curve_measures(added), (first, last)), added)
    return curve.select("hour", "turns", "efficiency")


def damage_vs_repair(
    cascades: DataFrame | Source, legs: DataFrame | Source, where: Slice, added: int = 10
) -> DataFrame:
    """Both curves by hour; hours of either curve are kept. One pass over the hours of both."""
    damage, repair = filtered_damage(cascades, where), filtered_repair(legs, where, added)
    both = damage.unionByName(repair, allowMissingColumns=True)
    figures = [c for c in both.columns if c != "hour"]
    return both.groupBy("hour").agg(*[F.max(c).alias(c) for c in figures])


def worst_cascade_days(legs: DataFrame, where: Slice, settings: Settings = Settings()) -> DataFrame:
    """Aircraft days with a long cascade, most inherited minutes first."""
    return (
        sc.scorecard(
            where.apply(legs),
            AIRCRAFT_DAY,
            [
                sc.rows("legs"),
                sc.largest("longest_cascade", F.col("cascade_length")),
                sc.total("inherited_minutes", F.col("inherited_delay_minutes")),
                sc.largest("worst_arrival", F.col("arr_delay")),
            ],
        )
        .filter(F.col("longest_cascade") >= settings.worst_day_min_chain)
        .orderBy(F.col("inherited_minutes").desc(), *AIRCRAFT_DAY)
        .limit(settings.worst_day_rows)
    )


def one_aircraft_day(legs: DataFrame, tail: str, day: dt.date) -> DataFrame:
    """Legs of one aircraft on one day; the month folders are pruned by the date."""
    return Slice(date_from=day, date_to=day).apply(legs).filter(F.col("tail_number") == tail)


def _day() -> WindowSpec:
    """An aircraft's legs of one day, few as a day is short; windows of a day share one exchange."""
    return Window.partitionBy(*AIRCRAFT_DAY)


def rotation_timeline(legs: DataFrame) -> DataFrame:
    """Each aircraft day as legs with minutes from its first planned departure."""
    days = legs.withColumns(
        {
            "leg_seq": F.row_number().over(_day().orderBy("leg_seq")).cast("long"),
            "_base": F.min("sched_dep_utc").over(_day()),
        }
    )

    def minutes(end: str, start: str):
        return ((F.unix_seconds(end) - F.unix_seconds(start)) / F.lit(60)).cast("double")

    def hhmm(instant: str):
        return F.date_format(instant, "HH:mm")

    return days.select(
        *AIRCRAFT_DAY,
        "leg_seq",
        "origin",
        "dest",
        "dep_delay",
        "arr_delay",
        "inherited_delay_minutes",
        "turn_slack_minutes",
        "sched_turn_minutes",
        "cascade_position",
        "cascade_length",
        "primary_cause",
        "is_continuation",
        minutes("sched_dep_utc", "_base").alias("sched_offset"),
        minutes("actual_dep_utc", "_base").alias("actual_offset"),
        minutes("sched_arr_utc", "sched_dep_utc").alias("sched_minutes"),
        minutes("actual_arr_utc", "actual_dep_utc").alias("actual_minutes"),
        hhmm("sched_dep_utc").alias("sched_dep_hhmm"),
        hhmm("sched_arr_utc").alias("sched_arr_hhmm"),
        hhmm("actual_dep_utc").alias("actual_dep_hhmm"),
        hhmm("actual_arr_utc").alias("actual_arr_hhmm"),
    )


def cascade_start(legs: DataFrame) -> DataFrame:
    """First inheriting leg of each aircraft day and the day's inherited total."""
    through = F.col("is_continuation") & (F.col("inherited_delay_minutes") > 0)
    days = legs.withColumn("leg_seq", F.row_number().over(_day().orderBy("leg_seq")).cast("long")).withColumns(
        {
            "day_inherited_minutes": F.sum("inherited_delay_minutes").over(_day()),
            "start_leg": F.min(F.when(through, F.col("leg_seq"))).over(_day()),
        }
    )
    return days.filter(F.col("leg_seq") == F.col("start_leg")).select(
        *AIRCRAFT_DAY,
        "day_inherited_minutes",
        "start_leg",
        "origin",
        "dest",
        "turn_slack_minutes",
        "sched_turn_minutes",
        "inherited_delay_minutes",
    )


def rotation_breaks(legs: DataFrame) -> DataFrame:
    """Legs of each aircraft day that do not continue the leg before."""
    return legs.groupBy(*AIRCRAFT_DAY).agg(
        F.count("*").alias("legs"),
        F.count_if(~F.col("is_continuation")).alias("broken_legs"),
    )


def station_opportunities(opportunities: DataFrame, where: Slice, rows: int = 40, ranked: int = 10) -> DataFrame:
    """Stations ranked by what a buffer would absorb; dates do not apply here."""
    undated = Slice(where.carriers, where.airports)
    return (
        opportunities.filter(undated.predicate("airport_code"))
        .orderBy(F.col(f"minutes_saved_plus_{ranked}").desc(), "carrier", "airport_code")
        .limit(rows)
        .select(
            F.col("carrier_name").alias("carrier"),
            F.col("airport_code").alias("station"),
            F.concat(
                F.replace(F.col("carrier_name"), F.lit(" Airlines"), F.lit("")),
                F.lit(" · "),
                F.col("airport_code"),
            ).alias("label"),
            "city",
            "turns",
            F.col("median_sched_turn_minutes").alias("sched_turn"),
            F.col("min_feasible_turn_minutes").alias("min_turn"),
            F.col("median_slack_minutes").alias("slack"),
            F.col("tight_turn_pct").alias("tight_pct"),
            F.col(f"minutes_saved_plus_{ranked}").alias("minutes_saved"),
            F.col(f"efficiency_plus_{ranked}").alias("efficiency"),
            F.col(f"delay_cost_avoided_usd_plus_{ranked}").alias("cost_avoided_usd"),
        )
    )


def station_labels(ranked: DataFrame, rows: int = 12) -> DataFrame:
    """The first of the ranked stations with the label and figures a chart shows."""
    shown = ranked.orderBy(F.col("minutes_saved").desc(), "carrier", "station").limit(rows)
    return shown.select("label", "slack", "minutes_saved", "cost_avoided_usd")
