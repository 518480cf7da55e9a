"""Scorecards per carrier, station and route; cascades; buffer opportunities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlag.functions.clock import month_first
from flightlag.functions.numeric import percent, round_to
from flightlag.operators import scorecard as sc
from flightlag.operators.buffer import simulate_buffer
from flightlag.operators.cascades import roll_up_islands
from flightlag.settings import Settings

DONE = "completed"


def named(df: DataFrame, dimension: DataFrame, key: str, **columns: str) -> DataFrame:
    """Left join some columns of a dimension, renamed; ``key`` is df's column."""
    own = dimension.columns[0]
    picked = dimension.select(
        F.col(own).alias(key), *[F.col(source).alias(name) for name, source in columns.items()]
    )
    return df.join(picked, key, "left")


def _sums(names: Sequence[str]) -> list[sc.Measure]:
    return [sc.total(name, F.col(name)) for name in names]


def _arrival(p90: bool = True) -> list[sc.Measure]:
    done, late = F.col(DONE), F.col("arr_delay")
    out = [sc.mean("avg_arr_delay_minutes", late, done, 2)]
    if p90:
        out.append(sc.quantile("p90_arr_delay_minutes", late, 0.90, done, 1))
    return out


def mart_carrier_monthly(flights: DataFrame, carriers: DataFrame) -> DataFrame:
    """Carrier by month. Rates count cancelled and diverted legs, delays do not."""
    done = F.col(DONE)
    figures = sc.scorecard(
        flights,
        ["year", "month", "carrier"],
        [
            sc.rows("scheduled_flights"),
            sc.tally("completed_flights", done),
            sc.tally("cancelled_flights", F.col("cancelled")),
            sc.tally("diverted_flights", F.col("diverted")),
            sc.share("on_time_arrival_pct", F.col("is_on_time_a14"), 2),
            sc.share("completion_factor_pct", done, 2),
            sc.share("cancellation_rate_pct", F.col("cancelled"), 2),
            *_arrival(),
            sc.quantile("median_arr_delay_minutes", F.col("arr_delay"), 0.5, done, 1),
            *_sums(
                [
                    "root_delay_minutes",
                    "inherited_delay_minutes",
                    "controllable_root_minutes",
                    "external_root_minutes",
                ]
            ),
            sc.mean("avg_block_variance_minutes", F.col("block_time_variance"), done, 2),
        ],
    )
    root, inherited = F.col("root_delay_minutes"), F.col("inherited_delay_minutes")
    return named(
        figures.withColumns(
            {
                "month_start": month_first(F.col("year"), F.col("month")),
                "inherited_share_pct": round_to(percent(inherited, root + inherited), 1),
            }
        ),
        carriers,
        "carrier",
        carrier_name="carrier_name",
        carrier_type="carrier_type",
    )


def mart_airport_daily(flights: DataFrame, airports: DataFrame, dates: DataFrame) -> DataFrame:
    """Origin by day, from the departure side."""
    done = F.col(DONE)
    left_late = ~F.col("cancelled") & (F.col("dep_delay") >= 15)
    figures = sc.scorecard(
        flights.withColumnRenamed("origin", "airport_code"),
        ["flight_date", "airport_code"],
        [
            sc.rows("departures"),
            sc.distinct("carriers_operating", F.col("carrier")),
            sc.tally("cancellations", F.col("cancelled")),
            sc.share("cancellation_rate_pct", F.col("cancelled"), 2),
            sc.share("departures_delayed_pct", left_late, 2),
            sc.mean("avg_dep_delay_minutes", F.col("dep_delay"), done, 2),
            sc.quantile("p90_dep_delay_minutes", F.col("dep_delay"), 0.90, done, 1),
            sc.mean("avg_taxi_out_minutes", F.col("taxi_out"), done, 2),
            *_sums(["root_delay_minutes", "inherited_delay_minutes"]),
        ],
    )
    placed = named(figures, airports, "airport_code", city="city", size_band="size_band")
    return named(
        placed,
        dates,
        "flight_date",
        travel_period="travel_period",
        is_federal_holiday="is_federal_holiday",
        day_name="day_name",
    )


def mart_route_reliability(
    flights: DataFrame, airports: DataFrame, carriers: DataFrame, min_flights: int = 500
) -> DataFrame:
    """Route by carrier, for routes flown often enough to say something."""
    done = F.col(DONE)
    figures = sc.scorecard(
        flights,
        ["route", "origin", "dest", "carrier"],
        [
            sc.rows("flights"),
            sc.mean("distance_miles", F.col("distance_miles"), digits=0),
            sc.mean("avg_scheduled_block_minutes", F.col("crs_elapsed_time"), digits=1),
            sc.share("on_time_arrival_pct", F.col("is_on_time_a14"), 2),
            sc.share("cancellation_rate_pct", F.col("cancelled"), 2),
            *_arrival(),
            sc.mean("avg_block_variance_minutes", F.col("block_time_variance"), done, 2),
            sc.mean("avg_air_time_minutes", F.col("air_time"), done, 1),
            *_sums(["root_delay_minutes", "inherited_delay_minutes"]),
        ],
        min_rows=min_flights,
    )
    with_origin = named(
        figures, airports, "origin", origin_city="city", origin_size_band="size_band"
    )
    with_dest = named(with_origin, airports, "dest", dest_city="city")
    return named(with_dest, carriers, "carrier", carrier_name="carrier_name")


def mart_cascade(
    links: DataFrame, carriers: DataFrame, cost: Column, settings: Settings = Settings()
) -> DataFrame:
    """One row per root delay with everything it went on to delay."""
    return named(
        roll_up_islands(links, cost, settings.min_root_minutes),
        carriers,
        "carrier",
        carrier_name="carrier_name",
        carrier_type="carrier_type",
    )


def mart_turn_slack_opportunity(
    legs: DataFrame,
    airports: DataFrame,
    carriers: DataFrame,
    cost: Column,
    settings: Settings = Settings(),
) -> DataFrame:
    """Where a turn buffer would absorb the most delay."""
    stations = simulate_buffer(
        legs,
        cost,
        settings.added_buffers,
        settings.ranked_buffer,
        settings.tight_turn_minutes,
        settings.opportunity_min_turns,
    )
    placed = named(stations, airports, "airport_code", city="city", size_band="size_band")
    return named(placed, carriers, "carrier", carrier_name="carrier_name")
