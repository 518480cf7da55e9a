"""What must hold of the built tables."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightlag.functions.clock import minutes_between
from flightlag.functions.labels import CAUSES_BY_PRIORITY
from flightlag.functions.numeric import pearson, rate, ratio

from flightlag.operators.checks import Check, Groups, combine, equal, no_group, none, run_checks
from flightlag.sources.reference import one_row


@dataclass(frozen=True)
class Bounds:
    """Limits that describe a data set rather than the model."""

    # Five calendar years of scheduled domestic service.
    months: int = 60
    calendar_days: int = 1826
    flights_per_year: tuple[float, float] = (5_000_000, 9_000_000)
    unexplained_share: float = 0.0001
    invalid_schedules: tuple[float, float] = (0, 100)
    on_time_pct: tuple[float, float] = (70, 85)
    correlation: float = 0.70
    tight_over_loose: float = 1.5
    dst_station: str = "ORD"
    utc_offsets: int = 2


# Texts that stand for an unknown aircraft, and the leg key.
PLACEHOLDER_TAILS = ["UNKNOW", "N/A", "-N/A-", "000000", ""]
LEG_KEY = ["flight_date", "carrier", "flight_number", "origin", "dest", "crs_dep_time"]


def flight_checks(flights: DataFrame, b: Bounds = Bounds()) -> DataFrame:
    """Checks of the flight fact, repeated legs included, in one scan."""
    complete, attributed = F.col("has_complete_attribution"), F.col("has_cause_attribution")
    late = F.col("arr_delay_minutes")
    causes = sum((F.col(name) for name, _ in CAUSES_BY_PRIORITY), F.lit(0))
    split = F.col("root_delay_minutes") + F.col("inherited_delay_minutes")
    invalid = ~F.col("is_schedule_valid")
    offset = F.when(
        F.col("origin") == b.dst_station,
        F.hour("sched_dep_utc")
        - F.hour("sched_dep_local")
        + 24 * F.datediff(F.col("sched_dep_utc").cast("date"), F.col("sched_dep_local").cast("date")),
    )
    return run_checks(
        flights,
        [
            Check(
                "every_month_present",
                low=b.months,
                high=b.months,
                groups=Groups([F.col("year"), F.col("month")]),
            ),
            Check(
                "flights_per_year_plausible",
                F.count("*"),
                *b.flights_per_year,
                groups=Groups([F.col("year")]),
                combined=ratio,
            ),
            none("causes_sum_to_arrival_delay", complete & (F.abs(causes - late) > 1)),
            Check(
                "unexplained_delays_negligible",
                ratio(F.count_if(attributed & ~complete), F.count_if(attributed)),
                high=b.unexplained_share,
            ),
            none(
                "causes_only_on_late_arrivals",
                attributed & F.col("completed") & (F.col("arr_delay") < 15),
            ),
            none("root_and_inherited_partition_delay", complete & (F.abs(split - late) > 1)),
            none(
                "arrival_follows_departure",
                F.col("sched_arr_utc").isNotNull() & (F.col("sched_arr_utc") <= F.col("sched_dep_utc")),
            ),
            Check("invalid_schedules_flagged", F.count_if(invalid), *b.invalid_schedules),
            none("invalid_schedules_have_no_arrival", invalid & F.col("sched_arr_utc").isNotNull()),
            none(
                "departure_matches_reported_delay",
                F.col("completed")
                & (
                    minutes_between(F.col("sched_dep_utc"), F.col("actual_dep_utc"))
                    != F.col("dep_delay")
                ),
            ),
            Check(
                "daylight_saving_offsets",
                low=b.utc_offsets,
                high=b.utc_offsets,
                groups=Groups([offset]),
            ),
            none(
                "cancelled_never_on_time",
                (F.col("cancelled") | F.col("diverted")) & F.col("is_on_time_a14"),
            ),
            Check(
                "on_time_rate_in_band",
                rate(F.sum(F.col("is_on_time_a14").cast("int")), F.count("is_on_time_a14")),
                *b.on_time_pct,
            ),
            no_group(
                "no_duplicate_legs",
                Groups([F.col(k) for k in LEG_KEY], counted=lambda n: n > 1, nulls=True),
            ),
        ],
    )


def dimension_checks(
    airports: DataFrame, carriers: DataFrame, dates: DataFrame, b: Bounds = Bounds()
) -> DataFrame:
    unplaced = ~F.col("is_mapped") | F.col("timezone").isNull()
    return combine(
        [
            run_checks(airports, [none("every_airport_mapped", unplaced)]),
            run_checks(carriers, [none("every_carrier_named", ~F.col("is_mapped"))]),
            run_checks(dates, [equal("calendar_without_gaps", F.count("*"), b.calendar_days)]),
        ]
    )


def rotation_checks(legs: DataFrame, b: Bounds = Bounds()) -> DataFrame:
    """Checks of the rotation fact, roots of cascades included, in one scan."""
    turn = F.col("is_continuation")
    inherited = F.col("inherited_delay_minutes")
    comparable = turn & F.col("prev_arr_delay").between(30, 60)
    slack = F.col("turn_slack_minutes")
    tight = F.avg(F.when(comparable & (slack < 15), inherited))
    loose = F.avg(F.when(comparable & (slack >= 60), inherited))
    late = turn & (F.col("prev_arr_delay") > 15)
    return run_checks(
        legs,
        [
            none(
                "continuations_physically_possible",
                turn & ((F.col("prev_dest") != F.col("origin")) | (F.col("sched_turn_minutes") < 0)),
            ),
            none("no_placeholder_tails", F.col("tail_number").isin(PLACEHOLDER_TAILS)),
            Check(
                "model_tracks_reported",
                pearson(
                    F.when(late, F.col("predicted_inherited_minutes")),
                    F.when(late, inherited.cast("double")),
                ),
                low=b.correlation,
            ),
            Check("slack_reduces_inherited", ratio(tight, loose), low=b.tight_over_loose),
            no_group(
                "one_root_per_cascade",
                Groups(
                    [F.col("tail_number"), F.col("cascade_id")],
                    where=F.col("cascade_position") == 0,
                    counted=lambda n: n != 1,
                    nulls=True,
                ),
            ),
        ],
    )


def mart_checks(
    flights: int,
    carrier_monthly: DataFrame,
    airport_daily: DataFrame,
    route_reliability: DataFrame,
    cascade: DataFrame,
    opportunity: DataFrame,
) -> DataFrame:
    """Checks of the marts; ``flights`` is the number of rows of the flight fact."""

    def percentage(name: str, column: str) -> Check:
        return none(f"{name}_{column}_is_percentage", ~F.col(column).between(0, 100))

    def filled(name: str) -> Check:
        return Check(f"{name}_populated", F.count("*"), low=0)

    return combine(
        [
            run_checks(
                carrier_monthly,
                [
                    filled("carrier_monthly"),
                    percentage("carrier_monthly", "on_time_arrival_pct"),
                    percentage("carrier_monthly", "completion_factor_pct"),
                    equal(
                        "carrier_monthly_reconciles",
                        F.abs(F.sum("scheduled_flights") - F.lit(flights)),
                        0,
                    ),
                ],
            ),
            run_checks(
                airport_daily,
                [filled("airport_daily"), percentage("airport_daily", "cancellation_rate_pct")],
            ),
            run_checks(
                route_reliability,
                [filled("route_reliability"), percentage("route_reliability", "on_time_arrival_pct")],
            ),
            run_checks(cascade, [filled("cascade")]),
            run_checks(opportunity, [filled("turn_slack_opportunity")]),
        ]
    )


def dq_suite(wh, bounds: Bounds = Bounds()) -> DataFrame:
    """Every check as (check_name, observed, bound, passed); each table is read once.

    Marts are reconciled with the rows counted when the flight fact was written.
    """
    return combine(
        [
            flight_checks(wh.flight(), bounds),
            dimension_checks(wh.dim_airport(), wh.dim_carrier(), wh.dim_date(), bounds),
            rotation_checks(wh.rotation_leg(), bounds),
            mart_checks(
                wh.row_count("fct_flight"),
                wh.carrier_monthly(),
                wh.airport_daily(),
                wh.route_reliability(),
                wh.cascade(),
                wh.turn_slack_opportunity(),
            ),
        ]
    )


PROFILE = "table_name string, ordinal int, column_name string, data_type string, filled_rows long, table_rows long"


def table_profile(wh) -> DataFrame:
    """Columns of each model with type, place, filled rows and row count, as counted by the writes.

    One row per column of a model, so the whole is short: it enters the plan as one text.
    """
    fields = T.StructType.fromDDL(PROFILE)
    rows = [
        dict(zip(fields.names, (model, place, column, kind, filled, figures.rows)))
        for model, figures in wh.figures().items()
        for place, (column, kind, filled) in enumerate(figures.columns, 1)
    ]
    return one_row(wh.spark).select(F.inline(F.from_json(F.lit(json.dumps(rows)), T.ArrayType(fields))))


def counted_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """The same by reading every table: for tables that no store has counted."""
    out = []
    for table, df in tables.items():
        counts = df.agg(
            F.count("*").alias("_rows"), *[F.count(F.col(c)).alias(c) for c in df.columns]
        )
        rows = F.array(
            *[
                F.struct(
                    F.lit(table).alias("table_name"),
                    F.lit(place).alias("ordinal"),
                    F.lit(field.name).alias("column_name"),
                    F.lit(field.dataType.simpleString()).alias("data_type"),
                    F.col(field.name).alias("filled_rows"),
                    F.col("_rows").alias("table_rows"),
                )
                for place, field in enumerate(df.schema, 1)
            ]
        )
        out.append(counts.select(F.inline(rows)))
    return combine(out)
