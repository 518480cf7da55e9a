"""Findings: global figures, curves by hour and slack, rankings, experiments."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightlag.functions.numeric import from_units, open_bucket, pearson, percent, rate, ratio, whole_units
from flightlag.operators import scorecard as sc
from flightlag.operators.benchmark import interpolated
from flightlag.operators.buffer import buffer_curve
from flightlag.operators.filters import Slice
from flightlag.settings import Settings


def few(value: str | Column) -> Column:
    """Exact distinct count of something with few values (carriers, months).

    The set is combined in map tasks; unlike several distinct counts in one
    aggregation it does not multiply the rows.
    """
    return F.size(F.collect_set(value)).cast("long")


def scope(flights: DataFrame) -> DataFrame:
    """Size of the data and the headline rates."""
    done = F.col("completed")
    return flights.agg(
        F.count_distinct("tail_number").alias("airframes"),
        F.count("*").alias("flights"),
        few("carrier").alias("carriers"),
        few("origin").alias("airports"),
        F.min("flight_date").alias("first_day"),
        F.max("flight_date").alias("last_day"),
        rate(F.sum(F.col("is_on_time_a14").cast("int")), F.count("is_on_time_a14")).alias("a14_pct"),
        rate(F.sum(done.cast("int")), F.count("*")).alias("completion_pct"),
        rate(F.sum(F.col("cancelled").cast("int")), F.count("*")).alias("cancellation_pct"),
        F.avg(F.when(done, F.col("arr_delay"))).alias("mean_arr_delay"),
        interpolated(F.when(done, F.col("arr_delay")), 0.90).alias("p90_arr_delay"),
    )


def inherited_share(flights: DataFrame, cost: Column) -> DataFrame:
    """How much delay arrived with the aircraft, and what it cost."""
    root, inherited = F.col("root_minutes"), F.col("inherited_minutes")
    return flights.agg(
        F.sum("root_delay_minutes").alias("root_minutes"),
        F.sum("inherited_delay_minutes").alias("inherited_minutes"),
    ).withColumns(
        {
            "total_minutes": root + inherited,
            "inherited_pct": percent(inherited, root + inherited),
            "root_pct": percent(root, root + inherited),
            "inherited_cost_usd": (inherited * cost).cast("decimal(38,2)"),
        }
    )


def model_validation(legs: DataFrame, late_from: int = 15) -> DataFrame:
    """Predicted against reported inherited delay of turns with a late inbound."""
    predicted, reported = F.col("predicted_inherited_minutes"), F.col("inherited_delay_minutes")
    return legs.filter(F.col("is_continuation") & (F.col("prev_arr_delay") > late_from)).agg(
        F.count("*").alias("turns"),
        ratio(from_units(F.sum(whole_units(predicted, 6)), 6), F.count(predicted)).alias(
            "mean_predicted"
        ),
        F.avg(reported).alias("mean_reported"),
        pearson(predicted, reported.cast("double")).alias("correlation"),
    )


def late_inbound_turns(legs: DataFrame, low: int = 30, high: int = 60) -> DataFrame:
    """Turns receiving a comparably late aircraft, with their slack bucket."""
    return legs.filter(
        F.col("is_continuation") & F.col("prev_arr_delay").between(low, high)
    ).withColumn("slack_floor", open_bucket(F.col("turn_slack_minutes"), 15, 90))


def slack_response(legs: DataFrame, low: int = 30, high: int = 60) -> DataFrame:
    return sc.scorecard(
        late_inbound_turns(legs, low, high),
        ["slack_floor"],
        [
            sc.rows("turns"),
            sc.mean("avg_inherited", F.col("inherited_delay_minutes")),
            sc.share("pct_late", F.col("dep_delay") >= 15),
        ],
    )


def slack_composition(legs: DataFrame, carrier: str, low: int = 30, high: int = 60) -> DataFrame:
    """Who is in each slack bucket, and how many were mid-cascade."""
    return sc.scorecard(
        late_inbound_turns(legs, low, high),
        ["slack_floor"],
        [
            sc.rows("turns"),
            sc.share("carrier_pct", F.coalesce(F.col("carrier") == carrier, F.lit(False))),
            sc.share("cascade_pct", F.col("cascade_position") > 0),
        ],
    )


def cascade_by_hour(cascades: DataFrame, first: int = 5, last: int = 22) -> DataFrame:
    """Damage done by one root delay, by its planned hour of departure."""
    return sc.scorecard(
        cascades.filter(F.col("root_dep_hour_local").between(first, last)).withColumnRenamed(
            "root_dep_hour_local", "hour"
        ),
        ["hour"],
        [
            sc.rows("roots"),
            sc.mean("legs", F.col("downstream_legs")),
            sc.mean("minutes", F.col("downstream_delay_minutes")),
            sc.mean("amplification", F.col("amplification_ratio"), places=2),
        ],
    )


def buffer_by_hour(legs: DataFrame, added: int = 10, first: int = 5, last: int = 22) -> DataFrame:
    """What a buffer minute buys, by planned hour of departure."""
    turns = legs.filter(F.col("sched_dep_hour_local").between(first, last)).withColumnRenamed(
        "sched_dep_hour_local", "hour"
    )
    return buffer_curve(turns, ["hour"], added).select("hour", "turns", "efficiency")


def _extreme(value: str, pick: str = "max") -> Column:
    """Hour of the extreme; of equal hours the earliest."""
    known = F.col(value).isNotNull()
    if pick == "max":
        return F.max_by("hour", F.when(known, F.struct(F.col(value), -F.col("hour"))))
    return F.min_by("hour", F.when(known, F.struct(F.col(value), F.col("hour"))))


def hour_extremes(damage: DataFrame, repair: DataFrame) -> DataFrame:
    """Peaks and troughs of both curves, from one row per hour."""
    by_hour = F.map_from_entries(F.collect_list(F.struct("hour", "amplification")))
    return (
        damage.join(repair, "hour", "full_outer")
        .agg(
            _extreme("legs").alias("peak_hour"),
            _extreme("legs", "min").alias("trough_hour"),
            ratio(F.max("legs"), F.min("legs")).alias("peak_to_trough"),
            _extreme("amplification").alias("amplification_hour"),
            F.max("amplification").alias("peak_amplification"),
            _extreme("efficiency").alias("best_buffer_hour"),
            F.max("efficiency").alias("best_efficiency"),
            F.avg(F.when(F.col("hour") <= 8, F.col("efficiency"))).alias("morning_efficiency"),
            by_hour.alias("_by_hour"),
        )
        .withColumn(
            "amplification_at_best", F.try_element_at("_by_hour", F.col("best_buffer_hour"))
        )
        .drop("_by_hour")
    )


def prevention_value(cascades: DataFrame, cost: Column, settings: Settings = Settings()) -> DataFrame:
    """What preventing part of the controllable morning root delay is worth."""
    first, last = settings.prevention_hours
    minutes, amp = F.col("controllable_minutes"), F.col("mean_amplification")
    saved = F.lit(settings.prevented_share) * minutes * amp
    return (
        cascades.filter(F.col("root_dep_hour_local").between(first, last))
        .agg(
            F.sum("root_controllable_minutes").alias("controllable_minutes"),
            ratio(
                from_units(F.sum(whole_units(F.col("amplification_ratio"), 2)), 2),
                F.count("amplification_ratio"),
            ).alias("mean_amplification"),
        )
        .withColumn("network_minutes_saved", saved)
        .withColumn(
            "usd_saved_per_year",
            F.col("network_minutes_saved") * cost.cast("double") / F.lit(settings.prevention_years),
        )
    )


def _weighted(rate: str, weight: str) -> Column:
    """Mean of a rate of two places, weighted by a count."""
    units = F.sum(F.col(weight) * whole_units(F.col(rate), 2))
    return ratio(from_units(units, 2), F.sum(weight))


def _inherited_pct() -> Column:
    root, inherited = F.sum("root_delay_minutes"), F.sum("inherited_delay_minutes")
    return percent(inherited, root + inherited)


def carrier_ranking(
    monthly: DataFrame, carriers: DataFrame, min_flights: int = 200_000
) -> DataFrame:
    """On-time rate weighted by flights, for carriers above a volume."""
    names = carriers.select("carrier", "carrier_name", "carrier_type")
    return (
        monthly.drop("carrier_name", "carrier_type")
        .join(names, "carrier")
        .groupBy("carrier_name", "carrier_type")
        .agg(
            F.sum("scheduled_flights").alias("flights"),
            _weighted("on_time_arrival_pct", "scheduled_flights").alias("a14_pct"),
            _inherited_pct().alias("inherited_pct"),
        )
        .filter(F.col("flights") > min_flights)
    )


def monthly_trend(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("month_start").agg(
        _weighted("on_time_arrival_pct", "scheduled_flights").alias("a14_pct"),
        _inherited_pct().alias("inherited_pct"),
    )


def carrier_station_slack(
    opportunities: DataFrame, carriers: DataFrame, pairs: Sequence[tuple[str, str]]
) -> DataFrame:
    """Slack at chosen (carrier name, station) pairs."""
    wanted = [F.struct(F.lit(name), F.lit(station)) for name, station in pairs]
    names = carriers.select("carrier", "carrier_name")
    return (
        opportunities.drop("carrier_name")
        .join(names, "carrier")
        .filter(F.struct("carrier_name", "airport_code").isin(*wanted))
        .select("carrier_name", "airport_code", "median_slack_minutes", "tight_turn_pct")
    )


def event_vs_control(
    flights: DataFrame,
    carrier: str,
    date_from: dt.date | None = None,
    date_to: dt.date | None = None,
) -> DataFrame:
    """Daily cancellation rate of one carrier and of all others, peak day marked."""
    window = Slice(date_from=date_from, date_to=date_to).apply(flights)
    own = F.col("carrier") == carrier
    lost = F.col("cancelled").cast("int")
    days = window.groupBy("flight_date").agg(
        rate(F.sum(F.when(own, lost)), F.count(F.when(own, lost))).alias("event_pct"),
        rate(F.sum(F.when(~own, lost)), F.count(F.when(~own, lost))).alias("control_pct"),
    )
    # One row per day, so the ranking needs no second look at the flights.
    worst_first = Window.orderBy(F.col("event_pct").desc_nulls_last(), "flight_date")
    return days.withColumn("is_peak", F.row_number().over(worst_first) == 1)


def cascade_length(cascades: DataFrame, longest: int = 8) -> DataFrame:
    return sc.scorecard(
        cascades.filter(F.col("downstream_legs") <= longest).withColumnRenamed(
            "downstream_legs", "length"
        ),
        ["length"],
        [sc.rows("cascades"), sc.mean("avg_minutes", F.col("downstream_delay_minutes"))],
    )


def top_stations(opportunities: DataFrame, rows: int = 10, ranked: int = 10) -> DataFrame:
    """Stations where the ranked buffer saves the most minutes."""
    return (
        opportunities.orderBy(
            F.col(f"minutes_saved_plus_{ranked}").desc(), F.col("carrier"), F.col("airport_code")
        )
        .limit(rows)
        .select(
            F.col("carrier_name").alias("carrier"),
            F.col("airport_code").alias("station"),
            "city",
            "turns",
            F.col("median_slack_minutes").alias("slack"),
            F.col("tight_turn_pct").alias("tight"),
            F.col(f"minutes_saved_plus_{ranked}").alias("saved"),
            (F.col(f"delay_cost_avoided_usd_plus_{ranked}") / 1e6).alias("cost_musd"),
        )
    )


# ---------------------------------------------------------------- described only


def turn_cutoff_sensitivity(
    links: DataFrame, cutoffs: Sequence[int] = (180, 360, 540, 720, 1080, 1440)
) -> DataFrame:
    """Turns and inherited minutes that count as propagation, per turn cut-off.

    One pass with a pair of conditional sums per cut-off, not a copy of the legs
    per cut-off.
    """
    matches = (F.col("prev_dest") == F.col("origin")) & (F.col("sched_turn_minutes") >= 0)
    minutes = F.col("inherited_delay_minutes")
    sums = []
    for n in cutoffs:
        inside = matches & (F.col("sched_turn_minutes") <= n)
        sums += [
            F.count_if(inside).alias(f"t{n}"),
            F.coalesce(F.sum(F.when(inside, minutes)), F.lit(0)).alias(f"m{n}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("max_turn_minutes"),
                F.col(f"t{n}").alias("turns"),
                F.col(f"m{n}").alias("inherited_minutes"),
            )
            for n in cutoffs
        ]
    )
    return links.agg(*sums).select(F.inline(rows))


def pilot_baseline(flights: DataFrame, first: int = 5, last: int = 10, effect: float = 0.05) -> DataFrame:
    """Late morning departures by carrier and station, and the sample per arm a
    two-proportion test needs to see them fall by ``effect`` (share points)."""
    z_alpha, z_power = 1.959963984540054, 0.8416212335729143  # two-sided 5 %, power 80 %
    p1 = F.col("late_share")
    p2 = F.greatest(p1 - effect, F.lit(0.0))
    variance = p1 * (1 - p1) + p2 * (1 - p2)
    morning = flights.filter(
        F.col("sched_dep_hour_local").between(first, last) & F.col("dep_delay").isNotNull()
    )
    return (
        morning.groupBy("carrier", F.col("origin").alias("airport_code"))
        .agg(
            F.count("*").alias("departures"),
            F.count_distinct("flight_date").alias("days"),
            F.count_if(F.col("dep_delay") >= 15).alias("late"),
        )
        .withColumn("late_share", ratio(F.col("late"), F.col("departures")))
        .withColumn("departures_per_day", ratio(F.col("departures"), F.col("days")))
        .withColumn(
            "sample_per_arm",
            F.ceil((z_alpha + z_power) ** 2 * variance / F.nullif((p1 - p2) ** 2, F.lit(0.0))),
        )
    )


def difference_in_differences(
    station_days: DataFrame, treated: Column, after: Column, outcome: str, places: int = 2
) -> DataFrame:
    """Change of the treated mean minus change of the untreated mean.

    ``outcome`` is a number of so many decimal places, summed exactly.
    """
    units = whole_units(F.col(outcome), places)
    cell = {
        "treated_before": treated & ~after,
        "treated_after": treated & after,
        "control_before": ~treated & ~after,
        "control_after": ~treated & after,
    }
    return station_days.agg(
        *[
            ratio(
                from_units(F.sum(F.when(where, units)), places), F.count(F.when(where, units))
            ).alias(name)
            for name, where in cell.items()
        ]
    ).withColumn(
        "effect",
        (F.col("treated_after") - F.col("treated_before"))
        - (F.col("control_after") - F.col("control_before")),
    )
