"""Tables and series handed to other tools."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlag.functions.numeric import percent, round_to
from flightlag.operators import scorecard as sc
from flightlag.operators.buffer import buffer_curve
from flightlag.plans import analyses
from flightlag.sources.sinks import json_document, write_csv


def export_airport_daily(daily: DataFrame, airports: DataFrame) -> DataFrame:
    """Station days of the larger airports."""
    larger = airports.filter(F.col("size_band").isin("Large", "Medium"))
    return daily.join(larger.select("airport_code"), "airport_code", "left_semi")


def export_route_reliability(routes: DataFrame, min_flights: int = 1000) -> DataFrame:
    return routes.filter(F.col("flights") >= min_flights)


def export_cascade_by_hour(cascades: DataFrame) -> DataFrame:
    return sc.scorecard(
        cascades.withColumnRenamed("root_dep_hour_local", "dep_hour"),
        ["dep_hour", "carrier", "carrier_name", "carrier_type"],
        [
            sc.rows("root_delays"),
            sc.mean("avg_downstream_legs", F.col("downstream_legs"), digits=3),
            sc.mean("avg_downstream_minutes", F.col("downstream_delay_minutes"), digits=2),
            sc.mean("avg_amplification", F.col("amplification_ratio"), digits=3, places=2),
            sc.total("total_cascade_minutes", F.col("total_cascade_minutes")),
            sc.total("_usd", F.col("total_cascade_cost_usd")),
        ],
    ).withColumn("total_cascade_cost_usd", F.round("_usd", 0).cast("decimal(38,0)")).drop("_usd")


def export_cascade_length(cascades: DataFrame) -> DataFrame:
    return sc.scorecard(
        cascades.withColumnRenamed("downstream_legs", "cascade_length"),
        ["cascade_length", "carrier_type"],
        [
            sc.rows("cascades"),
            sc.mean("avg_downstream_minutes", F.col("downstream_delay_minutes"), digits=1),
            sc.mean("avg_amplification", F.col("amplification_ratio"), digits=3, places=2),
        ],
    )


def export_buffer_by_hour(legs: DataFrame, added: int = 10) -> DataFrame:
    curve = buffer_curve(
        legs.withColumnRenamed("sched_dep_hour_local", "turn_hour"), ["turn_hour", "carrier"], added
    )
    return curve.select(
        "turn_hour",
        "carrier",
        "turns",
        round_to(F.col("predicted_base"), 0).alias("predicted_inherited_base"),
        round_to(F.col("predicted_with_buffer"), 0).alias(f"predicted_inherited_plus_{added}"),
        round_to(F.col("efficiency"), 4).alias("buffer_efficiency"),
    )


@dataclass(frozen=True)
class Export:
    name: str
    table: Callable[[], DataFrame]
    order: tuple = ()
    # Reports bounded by hours, chain lengths and carriers fit in one file.
    single_file: bool = False


def all_exports(wh) -> list[Export]:
    """The ten exports over a warehouse."""
    return [
        Export("carrier_monthly", wh.carrier_monthly),
        Export(
            "route_reliability",
            lambda: export_route_reliability(
                wh.route_reliability(), wh.settings.route_export_min_flights
            ),
            (F.col("flights").desc(), "route", "carrier"),
        ),
        Export("turn_slack_opportunity", wh.turn_slack_opportunity),
        Export("airport_daily", lambda: export_airport_daily(wh.airport_daily(), wh.dim_airport())),
        Export("dim_airport", wh.dim_airport),
        Export("dim_carrier", wh.dim_carrier),
        Export("dim_date", wh.dim_date),
        Export(
            "cascade_by_hour",
            lambda: export_cascade_by_hour(wh.cascade()),
            ("dep_hour", "carrier"),
            True,
        ),
        Export(
            "cascade_length_distribution",
            lambda: export_cascade_length(wh.cascade()),
            ("cascade_length", "carrier_type"),
            True,
        ),
        Export(
            "buffer_efficiency_by_hour",
            lambda: export_buffer_by_hour(wh.rotation_leg()),
            ("turn_hour", "carrier"),
            True,
        ),
    ]


def write_exports(wh, root: str) -> None:
    for export in all_exports(wh):
        write_csv(export.table(), f"{root}/{export.name}", export.order, export.single_file)


# ------------------------------------------------------------------ report payload


def payload_meta(wh) -> DataFrame:
    """The headline record."""
    flights, s = wh.flight(), wh.settings
    scope = analyses.scope(flights)
    split = analyses.inherited_share(flights, wh.cost())
    model = analyses.model_validation(wh.rotation_leg())
    root, inherited = split.select("root_minutes").scalar(), split.select("inherited_minutes").scalar()
    return scope.select(
        "flights",
        "carriers",
        "airports",
        "airframes",
        F.col("first_day").cast("string").alias("from"),
        F.col("last_day").cast("string").alias("to"),
        round_to(F.col("a14_pct"), 2).alias("a14"),
        round_to(F.col("completion_pct"), 2).alias("completion"),
        round_to(F.col("cancellation_pct"), 2).alias("cancel"),
        round_to(F.col("mean_arr_delay"), 1).alias("mean_delay"),
        round_to(F.col("p90_arr_delay"), 0).alias("p90_delay"),
        round_to(root / 1e6, 1).alias("root_m"),
        round_to(inherited / 1e6, 1).alias("inherited_m"),
        round_to(percent(inherited, root + inherited), 1).alias("inherited_pct"),
        round_to(inherited * wh.cost().cast("double") / 1e9, 2).alias("inherited_cost_bn"),
        round_to(model.select("correlation").scalar(), 3).alias("corr"),
        round_to(model.select("mean_predicted").scalar(), 1).alias("model_pred"),
        round_to(model.select("mean_reported").scalar(), 1).alias("model_reported"),
        model.select("turns").scalar().alias("model_turns"),
        wh.cost().cast("double").alias("block_minute_usd"),
    )


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: round_to(F.col(c), n) for c, n in digits.items()})


def payload_series(wh, event_from=None, event_to=None) -> dict[str, tuple[DataFrame, list[str]]]:
    """The chart series, each with the columns that order it.

    Their length is bounded by hours, slack buckets, chain lengths, months, the
    days of the event window and the top-k of the report, never by the data.
    """
    s = wh.settings
    return {
        "cascade_by_hour": (
            _rounded(
                analyses.cascade_by_hour(wh.cascade(), s.first_hour, s.last_hour),
                legs=3, minutes=1, amplification=3,
            ),
            ["hour"],
        ),
        "buffer_by_hour": (
            _rounded(
                analyses.buffer_by_hour(wh.rotation_leg(), s.ranked_buffer, s.first_hour, s.last_hour),
                efficiency=4,
            ),
            ["hour"],
        ),
        "slack_response": (
            _rounded(analyses.slack_response(wh.rotation_leg()), avg_inherited=1, pct_late=1),
            ["slack_floor"],
        ),
        "cascade_length": (
            _rounded(analyses.cascade_length(wh.cascade(), s.longest_reported_chain), avg_minutes=1),
            ["length"],
        ),
        "carriers": (
            _rounded(
                analyses.carrier_ranking(
                    wh.carrier_monthly(), wh.dim_carrier(), s.ranking_min_flights
                ).select(
                    F.col("carrier_name").alias("name"),
                    F.col("carrier_type").alias("type"),
                    "flights",
                    F.col("a14_pct").alias("a14"),
                    "inherited_pct",
                ),
                a14=2, inherited_pct=1,
            ),
            [-F.col("a14"), "name"],
        ),
        "stations": (
            _rounded(
                analyses.top_stations(wh.turn_slack_opportunity(), s.top_station_rows, s.ranked_buffer), cost_musd=1
            ),
            [-F.col("saved"), "carrier", "station"],
        ),
        "event": (
            _rounded(
                analyses.event_vs_control(wh.flight(), s.focus_carrier, event_from, event_to).select(
                    F.col("flight_date").cast("string").alias("date"), "event_pct", "control_pct"
                ),
                event_pct=1, control_pct=1,
            ),
            ["date"],
        ),
        "monthly": (
            _rounded(
                analyses.monthly_trend(wh.carrier_monthly()).select(
                    F.col("month_start").cast("string").alias("month"),
                    F.col("a14_pct").alias("a14"),
                    "inherited_pct",
                ),
                a14=2, inherited_pct=1,
            ),
            ["month"],
        ),
    }


def payload_rows(wh, event_from=None, event_to=None) -> DataFrame:
    """The payload in long form: series, item, measure, value."""
    out = None
    for name, (df, _) in payload_series(wh, event_from, event_to).items():
        keys = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
        if not keys:
            keys = [df.columns[0]]
        figures = [c for c in df.columns if c not in keys]
        item = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        long = df.select(item.alias("item"), *[F.col(c).cast("double").alias(c) for c in figures]).unpivot(
            ["item"], figures, "measure", "value"
        ).withColumn("series", F.lit(name))
        out = long if out is None else out.unionByName(long)
    meta = payload_meta(wh)
    figures = [c for c in meta.columns if c not in ("from", "to")]
    head = meta.select(
        F.concat_ws("|", "from", "to").alias("item"), *[F.col(c).cast("double").alias(c) for c in figures]
    ).unpivot(["item"], figures, "measure", "value").withColumn("series", F.lit("meta"))
    return out.unionByName(head).select("series", "item", "measure", "value")


def payload_document(wh, event_from=None, event_to=None) -> DataFrame:
    """The payload as one JSON text."""
    return json_document(payload_meta(wh), payload_series(wh, event_from, event_to))
