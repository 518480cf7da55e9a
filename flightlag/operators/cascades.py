"""Islands of inherited delay rolled up to their root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlag.functions.numeric import ratio, round_to

# Root leg columns under the names reports use.
ROOT_COLUMNS = {
    "tail_number": "tail_number",
    "cascade_id": "cascade_id",
    "carrier": "carrier",
    "flight_date": "flight_date",
    "origin": "root_origin",
    "dest": "root_dest",
    "sched_dep_utc": "root_sched_dep_utc",
    "sched_dep_hour_local": "root_dep_hour_local",
    "arr_delay": "root_arr_delay",
    "root_delay_minutes": "root_delay_minutes",
    "controllable_root_minutes": "root_controllable_minutes",
    "external_root_minutes": "root_external_minutes",
    "primary_cause": "root_primary_cause",
}
ISLAND = ["tail_number", "cascade_id"]


def roll_up_islands(links: DataFrame, cost_per_minute: Column, min_root: int = 1) -> DataFrame:
    """One row per cascade whose root lost at least ``min_root`` minutes itself.

    One aggregation by cascade: the root's columns, sums over the legs after it, and
    the set of stations they touched, which is no larger than the list of stations.
    Map tasks combine, so a long cascade of one aircraft is no large group.
    """
    root, later = F.col("cascade_position") == 0, F.col("cascade_position") > 0
    lost = root & (F.col("root_delay_minutes") >= min_root)
    kept = F.struct(*[F.col(c).alias(name) for c, name in ROOT_COLUMNS.items() if c not in ISLAND])
    figures = links.groupBy(*ISLAND).agg(
        F.max(F.when(lost, kept)).alias("_root"),
        F.count_if(later).alias("downstream_legs"),
        F.sum(F.when(later, F.col("inherited_delay_minutes"))).alias("downstream_delay_minutes"),
        F.size(F.collect_set(F.when(later, F.col("dest")))).alias("downstream_stations_touched"),
    )
    counts = ["downstream_legs", "downstream_delay_minutes", "downstream_stations_touched"]
    total = F.col("root_delay_minutes") + F.col("downstream_delay_minutes")
    return (
        figures.filter(F.col("_root").isNotNull())
        .select(*ISLAND, "_root.*", *counts)
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in counts})
        .withColumns(
            {
                "total_cascade_minutes": total.cast("long"),
                "amplification_ratio": round_to(ratio(total, F.col("root_delay_minutes")), 2),
            }
        )
        .withColumn(
            "total_cascade_cost_usd",
            (F.col("total_cascade_minutes") * cost_per_minute).cast("decimal(38,2)"),
        )
    )
