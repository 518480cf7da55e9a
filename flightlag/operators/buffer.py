"""What added ground time would have saved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlag.functions.numeric import floor_at_zero, ratio, round_to
from flightlag.operators import scorecard as sc

# Predicted minutes are summed in millionths: floors are interpolated.
PLACES = 6


def handed_on(added: int = 0) -> Column:
    """Delay passed to the next leg had the turn held ``added`` more minutes."""
    inbound = F.coalesce(F.col("prev_arr_delay"), F.lit(0))
    return floor_at_zero(inbound - (F.col("turn_slack_minutes") + F.lit(added)))


def efficiency(base: str, with_buffer: str, turns: str, added: int) -> Column:
    """Minutes saved per buffer minute spent."""
    return ratio(F.col(base) - F.col(with_buffer), F.lit(float(added)) * F.col(turns))


def curve_measures(added: int = 10) -> list[sc.Measure]:
    return [
        sc.rows("turns"),
        sc.total("predicted_base", handed_on(), PLACES),
        sc.total("predicted_with_buffer", handed_on(added), PLACES),
    ]


def buffer_curve(legs: DataFrame, keys: Sequence[str], added: int = 10) -> DataFrame:
    """Predicted minutes with and without a buffer, per key, over real turns."""
    return with_efficiency(sc.scorecard(legs.filter("is_continuation"), keys, curve_measures(added)), added)


def with_efficiency(curve: DataFrame, added: int = 10) -> DataFrame:
    return curve.withColumn(
        "efficiency", efficiency("predicted_base", "predicted_with_buffer", "turns", added)
    )


def simulate_buffer(
    legs: DataFrame,
    cost_per_minute: Column,
    added: Sequence[int] = (5, 10, 15),
    ranked: int = 10,
    tight_minutes: int = 15,
    min_turns: int = 2000,
) -> DataFrame:
    """Per carrier and station: turn medians, what-if savings, efficiency, cost.

    The benchmark level follows from carrier and station, so it is a key as well.
    """
    slack = F.col("turn_slack_minutes")
    turns = legs.filter("is_continuation").withColumnRenamed("origin", "airport_code")
    figures = sc.scorecard(
        turns,
        ["carrier", "airport_code", "benchmark_level"],
        [
            sc.rows("turns"),
            sc.quantile("median_sched_turn_minutes", F.col("sched_turn_minutes"), 0.5, digits=0),
            sc.quantile("min_feasible_turn_minutes", F.col("min_turn_minutes"), 0.5, digits=0),
            sc.quantile("median_slack_minutes", slack, 0.5, digits=0),
            sc.share("tight_turn_pct", slack < tight_minutes, digits=1),
            sc.total("actual_inherited_minutes", F.col("inherited_delay_minutes")),
            sc.total("_base", handed_on(), PLACES),
            *[sc.total(f"_with_{n}", handed_on(n), PLACES) for n in added],
        ],
        min_rows=min_turns,
    )
    saved = {f"minutes_saved_plus_{n}": F.col("_base") - F.col(f"_with_{n}") for n in added}
    best = f"minutes_saved_plus_{ranked}"
    return (
        figures.withColumns(saved)
        .withColumns(
            {
                f"efficiency_plus_{ranked}": round_to(
                    efficiency("_base", f"_with_{ranked}", "turns", ranked), 3
                ),
                f"delay_cost_avoided_usd_plus_{ranked}": round_to(
                    F.col(best) * cost_per_minute, 0
                ),
            }
        )
        .drop("_base", *[f"_with_{n}" for n in added])
    )
