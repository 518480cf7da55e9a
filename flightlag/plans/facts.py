"""The flight fact and the rotation fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlag.functions.clock import hhmm_hour
from flightlag.functions.labels import CAUSES_BY_PRIORITY, cancellation_reason, primary_cause
from flightlag.operators.benchmark import benchmark_floor
from flightlag.operators.delay import attribution_flags, split_root_inherited
from flightlag.operators.islands import islands
from flightlag.operators.propagation import propagate
from flightlag.operators.sequence import Chunked, Cuts, Keep, find_cuts, sequence_entities
from flightlag.operators.turns import flyable_legs, link_turns
from flightlag.settings import Settings
from flightlag.sources.tables import keep_in_scratch

# Columns of the flight fact taken over from staging, where the feed has them.
KEPT = [
    "flight_date",
    "carrier",
    "flight_number",
    "tail_number",
    "origin",
    "dest",
    "quarter",
    "day_of_week",
    "sched_dep_utc",
    "sched_arr_utc",
    "actual_dep_utc",
    "actual_arr_utc",
    "sched_dep_local",
    "crs_dep_time",
    "dep_time_block",
    "cancelled",
    "cancellation_code",
    "diverted",
    "is_schedule_valid",
    "dep_delay",
    "dep_delay_minutes",
    "dep_del15",
    "arr_delay",
    "arr_delay_minutes",
    "arr_del15",
    "taxi_out",
    "taxi_in",
    "crs_elapsed_time",
    "actual_elapsed_time",
    "air_time",
    "distance_miles",
    "distance_group",
    "carrier_delay",
    "weather_delay",
    "nas_delay",
    "security_delay",
    "late_aircraft_delay",
    "year",
    "month",
]

# What is the same on every flown leg: neither shuffled nor stored with the rotation.
SAME_WHEN_FLOWN = {
    "cancelled": (False, "boolean"),
    "diverted": (False, "boolean"),
    "completed": (True, "boolean"),
    "is_schedule_valid": (True, "boolean"),
    "cancellation_code": (None, "string"),
    "cancellation_reason": (None, "string"),
}

# What the rotation needs of the leg before.
CARRIED = [
    "dest",
    "carrier",
    "flight_date",
    "flight_number",
    "origin",
    "sched_arr_utc",
    "actual_arr_utc",
    "arr_delay",
    "root_delay_minutes",
    "inherited_delay_minutes",
    "primary_cause",
]
# What links legs besides their order and the columns carried over.
LINKING = ["actual_dep_utc"]
BESIDE = "_beside"


def fct_flight(staged: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per scheduled leg with outcome flags and the delay split.

    Row-wise only: the input's layout by month is kept and nothing is shuffled.
    """
    finished = ~F.col("cancelled") & ~F.col("diverted")
    causes = [name for name, _ in CAUSES_BY_PRIORITY]
    wanted = dict.fromkeys([*KEPT, *settings.tie_break])
    flights = staged.select(*[c for c in wanted if c in staged.columns]).withColumns(
        {
            "route": F.concat("origin", F.lit("-"), "dest"),
            "sched_dep_hour_local": hhmm_hour(F.col("crs_dep_time"), settings.clock),
            "cancellation_reason": cancellation_reason(F.col("cancellation_code")),
            "completed": finished,
            "is_on_time_a14": F.when(
                F.col("cancelled") | F.col("diverted"), F.lit(False)
            ).otherwise(F.col("arr_delay") < settings.on_time_minutes),
            "block_time_variance": F.col("actual_elapsed_time") - F.col("crs_elapsed_time"),
            "primary_cause": primary_cause(),
        }
    )
    flights = attribution_flags(flights, causes, "late_aircraft_delay")
    return split_root_inherited(flights)


def leg_order(settings: Settings) -> list[str]:
    return ["sched_dep_utc", *settings.tie_break]


def rotation_cuts(flights: DataFrame, settings: Settings = Settings(), keep: Keep = keep_in_scratch) -> Cuts:
    """Where legs of aircraft with very many are cut; small tables that ``keep`` stores."""
    return find_cuts(
        flyable_legs(flights),
        ["tail_number"],
        "sched_dep_utc",
        leg_order(settings),
        CARRIED,
        settings.max_rows_per_sequence,
        keep,
        "rotation_cuts",
    )


def rotation_links(
    flights: DataFrame,
    settings: Settings = Settings(),
    cuts: Cuts | None = None,
    keep: Keep = keep_in_scratch,
    rows: int = 0,
) -> DataFrame:
    """Legs of each aircraft in order, linked into turns and cascades.

    Sequence, links and islands share one scan and one exchange by aircraft. Cascades
    depend on the links and the reported causes only, so they are found here rather than
    after the benchmark join. ``rows`` is how many flights there are, if that is known.
    """
    legs = flyable_legs(flights).drop(*SAME_WHEN_FLOWN)
    cuts = cuts or rotation_cuts(flights, settings, keep)
    links = chain_legs(sequence_entities(_packed(legs, settings), cuts, rows=rows), settings, keep).drop_chunk()
    own = ["tail_number", *[c for c in legs.columns if c != "tail_number"]]
    told = [c for c in links.columns if c not in (*own, BESIDE)]
    return links.select(*[F.col(c if c in links.columns else f"{BESIDE}.{c}") for c in own], *told)


def _packed(legs: DataFrame, settings: Settings) -> DataFrame:
    """Legs with all that neither orders nor links them in one struct.

    Every window copies its rows; a struct is copied as a whole, its columns are not.
    """
    used = {"tail_number", *leg_order(settings), *CARRIED, *LINKING}
    beside = [c for c in legs.columns if c not in used]
    return legs.select(*[c for c in legs.columns if c in used], *([F.struct(*beside).alias(BESIDE)] if beside else []))


def chain_legs(seq: Chunked, settings: Settings, keep: Keep = keep_in_scratch) -> Chunked:
    """Turns and cascades of legs that know the leg before."""
    seq = seq.with_rows(link_turns(seq.rows, settings.max_turn_minutes))
    inheriting = F.col("is_continuation") & (F.col("inherited_delay_minutes") > 0)
    seq = seq.with_rows(seq.rows.withColumn("is_inheriting", inheriting))
    return islands(
        seq,
        F.col("is_inheriting"),
        id_name="cascade_id",
        position_name="cascade_position",
        length_name="cascade_length",
        keep=keep,
        label="rotation_islands",
    )


def ref_min_turn(links: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fastest turns achieved by carrier and station."""
    turns = links.filter(
        F.col("is_continuation")
        & (F.col("actual_turn_minutes") > 0)
        & (F.col("actual_turn_minutes") <= settings.max_turn_minutes)
    ).select("carrier", F.col("origin").alias("airport"), "actual_turn_minutes")
    return benchmark_floor(
        turns,
        "actual_turn_minutes",
        "carrier",
        "airport",
        settings.floor_quantile,
        settings.min_sample,
    ).withColumnRenamed("floor_value", "min_turn_minutes")


def fct_rotation_leg(links: DataFrame, min_turn: DataFrame) -> DataFrame:
    """Linked legs with slack and predicted inherited delay; no further windows."""
    same = {name: F.lit(value).cast(kind) for name, (value, kind) in SAME_WHEN_FLOWN.items()}
    return propagate(links, min_turn).withColumns(same)
