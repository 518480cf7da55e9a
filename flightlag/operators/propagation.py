"""Slack of a turn and the delay it is expected to hand on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlag.functions.numeric import floor_at_zero


def propagate(
    legs: DataFrame, min_turn: DataFrame, default_floor: Column | None = None
) -> DataFrame:
    """Join the turn floor of (carrier, origin) and predict the inherited delay.

    The floor table is read from storage, so Spark knows its size and broadcasts
    it only while small. A leg without a floor has no slack, unless a default
    floor is given.
    """
    floors = min_turn.select(
        F.col("carrier"), F.col("airport").alias("origin"), "min_turn_minutes", "benchmark_level"
    )
    floor = F.col("min_turn_minutes")
    if default_floor is not None:
        floor = F.coalesce(floor, default_floor)
    slack = floor_at_zero(F.col("sched_turn_minutes") - floor)
    late_inbound = F.col("is_continuation") & (F.col("prev_arr_delay") > 0)
    return (
        legs.join(floors, ["carrier", "origin"], "left")
        .withColumn("turn_slack_minutes", slack.cast("double"))
        .withColumn(
            "predicted_inherited_minutes",
            F.when(
                late_inbound,
                floor_at_zero(F.col("prev_arr_delay") - F.col("turn_slack_minutes")),
            )
            .otherwise(F.lit(0))
            .cast("double"),
        )
        .withColumn(
            "inherited_prediction_error",
            F.col("inherited_delay_minutes") - F.col("predicted_inherited_minutes"),
        )
    )
