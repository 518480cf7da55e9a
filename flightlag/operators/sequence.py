"""Ordered sequences per entity, safe for entities with very many rows.

A window per entity puts all its rows in one task. So the rows of an entity that has
more than ``max_rows`` are cut into chunks of ``max_rows`` in their order, and windows run
per (entity, chunk). Where the cuts fall is found once and kept as small tables; given
these, a sequence reads its rows once and deals them out once, whether or not
anything is long. What crosses a cut comes with the cut: the rows on both its sides.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from flightlag.sources.tables import keep_in_scratch

CHUNK = "_chunk"
#: Rows that a task sorts, of a table whose number of rows is known.
ROWS_IN_TASK = 100_000
#: Stores a small table and reads it back: (table, label) to table.
Keep = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Cuts:
    """Where the rows of long entities are cut.

    ``units`` has a row per long entity and unit of time: the chunk its first row is in
    and, in order, the last rows of chunks that end in the unit. ``edges`` has a row per
    chunk: the carried columns of the row before its first and of the row after its last.
    Both are None where no entity is long.
    """

    entity: tuple[str, ...]
    at: str
    order: tuple[str, ...]
    carry: tuple[str, ...]
    max_rows: int
    grain: str
    units: DataFrame | None = None
    edges: DataFrame | None = None

    def unit(self) -> Column:
        return F.date_trunc(self.grain, F.col(self.at))


@dataclass(frozen=True)
class Chunked:
    """Rows with their chunk: 0, 1, .. in entities that are cut, -1 in all others."""

    rows: DataFrame
    cuts: Cuts

    @property
    def entity(self) -> tuple[str, ...]:
        return self.cuts.entity

    @property
    def keys(self) -> list[str]:
        return [*self.entity, CHUNK]

    @property
    def is_cut(self) -> bool:
        return self.cuts.units is not None

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*[F.col(c).asc() for c in self.cuts.order])

    def with_rows(self, rows: DataFrame) -> Chunked:
        return replace(self, rows=rows)

    def split_rows(self) -> DataFrame:
        """Only the rows of entities that were cut."""
        return self.rows.filter(F.col(CHUNK) >= 0)

    def drop_chunk(self) -> DataFrame:
        return self.rows.drop(CHUNK)


def _rows_at_cuts(rows: DataFrame, units: DataFrame, cuts: Cuts, grains: Sequence[str]) -> DataFrame:
    """The rows on both sides of every cut, with their place in the entity from 0.

    Units of time in which a cut falls are opened by finer units, and at last by row: only
    rows that share the finest unit with a cut are ever sorted.
    """
    keys, max_rows = list(cuts.entity), cuts.max_rows
    # A unit with places from .. to - 1 has one of these if it has the first row of a chunk but 0 or the last of one.
    first_in = F.greatest(F.ceil(F.col("_before") / max_rows), F.lit(1)) * max_rows
    last_in = F.floor(F.col("_before") / max_rows) * max_rows + max_rows - 1
    reached = F.col("_before") + F.col("_n")
    met = units.filter((first_in < reached) | (last_in < reached))
    opened = rows.withColumn("_unit", cuts.unit()).join(met.select(*keys, "_unit", "_before"), [*keys, "_unit"])
    for grain in grains:
        opened = opened.withColumn("_unit", F.date_trunc(grain, F.col(cuts.at)))
        counts = opened.groupBy(*keys, "_before", "_unit").agg(F.count("*").alias("_n"))
        within = Window.partitionBy(*keys, "_before").orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
        finer = counts.select(
            *keys,
            "_unit",
            "_n",
            (F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0))).alias("_before"),
        ).filter((first_in < reached) | (last_in < reached))
        opened = opened.drop("_before").join(finer.select(*keys, "_unit", "_before"), [*keys, "_unit"])
    rank = F.row_number().over(Window.partitionBy(*keys, "_before").orderBy(*cuts.order)) - 1
    placed = opened.withColumn("_place", (F.col("_before") + rank).cast("long"))
    in_chunk = F.col("_place") % max_rows
    beside = (in_chunk == max_rows - 1) | ((in_chunk == 0) & (F.col("_place") > 0))
    return placed.filter(beside).drop("_before", "_unit")


def find_cuts(
    df: DataFrame,
    entity: Sequence[str],
    at: str,
    order: Sequence[str],
    carry: Sequence[str] = (),
    max_rows: int = 2_000_000,
    keep: Keep = keep_in_scratch,
    label: str = "cuts",
    grain: str = "hour",
    finer: Sequence[str] = ("second",),
) -> Cuts:
    """Count the rows of every entity and cut those with more than ``max_rows``.

    ``order`` is a total order within an entity and ``at`` its leading non-null time.
    ``carry`` names the columns that later steps want from the row before or after. The
    first count reads the entity columns only, and where it finds nothing long, that is
    all. The tables found are kept by ``keep``, so nothing is worked out twice.
    """
    cuts = Cuts(tuple(entity), at, tuple(order), tuple(carry), max_rows, grain)
    keys = list(entity)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size")).filter(F.col("_size") > max_rows)
    sizes = keep(sizes.filter(F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda known: known)), f"{label}_long")
    if sizes.isEmpty():
        return cuts
    rows = df.select(*dict.fromkeys([*keys, at, *order, *carry])).join(sizes.select(*keys), keys, "left_semi")
    counts = rows.groupBy(*keys, cuts.unit().alias("_unit")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("long")
    units = keep(counts.withColumn("_before", before), f"{label}_counts")
    sides = keep(_rows_at_cuts(rows, units, cuts, finer), f"{label}_sides")

    is_last = F.col("_place") % max_rows == max_rows - 1
    place = F.struct(*[F.col(c) for c in order])
    inside = sides.filter(is_last).groupBy(*keys, cuts.unit().alias("_unit")).agg(
        F.sort_array(F.collect_list(place)).alias("_inside")
    )
    first_chunk = F.floor(F.col("_before") / max_rows).cast("long")
    splitters = units.select(*keys, "_unit", first_chunk.alias("_first")).join(inside, [*keys, "_unit"], "left")
    carried = F.struct(F.lit(True).alias("_there"), *[F.col(c) for c in carry])
    chunk = F.floor(F.col("_place") / max_rows).cast("long")
    # The last row of a chunk comes before the next chunk, a first row after the one before.
    lasts = sides.filter(is_last).select(*keys, (chunk + 1).alias(CHUNK), carried.alias("_before"))
    is_first = (F.col("_place") % max_rows == 0) & (F.col("_place") > 0)
    firsts = sides.filter(is_first).select(*keys, (chunk - 1).alias(CHUNK), carried.alias("_after"))
    edges = lasts.join(firsts, [*keys, CHUNK], "full_outer")
    return replace(cuts, units=keep(splitters, f"{label}_units"), edges=keep(edges, f"{label}_edges"))


def _number_below(values: Column, value: Column) -> Column:
    """How many of the sorted ``values`` are smaller, by halving."""
    halvings = F.ceil(F.log2(F.size(values) + F.lit(1.0))).cast("int")
    start = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
        below = F.get(values, middle) < value
        low = F.when(below, middle + 1).otherwise(span["low"])
        high = F.when(below, span["high"]).otherwise(middle)
        return F.when(span["low"] < span["high"], F.struct(low.alias("low"), high.alias("high"))).otherwise(span)

    return F.aggregate(F.sequence(F.lit(1), halvings), start, halve, lambda span: span["low"])


def cut_sequences(df: DataFrame, cuts: Cuts) -> Chunked:
    """Give every row its chunk; chunks have at most ``max_rows`` rows.

    A row meets the cuts of its own unit of time only, by an equi-join with a stored
    table, and searches them by halving.
    """
    if cuts.units is None:
        return Chunked(df.withColumn(CHUNK, F.lit(-1).cast("long")), cuts)
    keys = list(cuts.entity)
    place = F.struct(*[F.col(c) for c in cuts.order])
    passed = F.when(F.col("_inside").isNull(), F.lit(0)).otherwise(_number_below(F.col("_inside"), place))
    chunk = F.when(F.col("_first").isNull(), F.lit(-1)).otherwise(F.col("_first") + passed).cast("long")
    met = df.withColumn("_unit", cuts.unit()).join(cuts.units, [*keys, "_unit"], "left")
    return Chunked(met.withColumn(CHUNK, chunk).drop("_unit", "_first", "_inside"), cuts)


def _row_number(seq: Chunked) -> Column:
    """All chunks before are full."""
    number = F.row_number().over(seq.window())
    if seq.is_cut:
        number = number + F.greatest(F.col(CHUNK), F.lit(0)) * seq.cuts.max_rows
    return number.cast("long")


def number_rows(seq: Chunked, name: str) -> Chunked:
    """Position of each row in its entity, from 1."""
    return seq.with_rows(seq.rows.withColumn(name, _row_number(seq)))


def _with_edges(seq: Chunked) -> DataFrame:
    return seq.rows.join(seq.cuts.edges, seq.keys, "left") if seq.is_cut else seq.rows


def neighbour(seq: Chunked, column: str, name: str, following: bool = False) -> Chunked:
    """``column`` of the row before (or after) in the same entity; it has to be carried over cuts."""
    beside = (F.lead if following else F.lag)(column).over(seq.window())
    if not seq.is_cut:
        return seq.with_rows(seq.rows.withColumn(name, beside))
    at_edge = (F.lead if following else F.lag)(F.lit(True)).over(seq.window()).isNull()
    across = F.col("_after" if following else "_before")[column]
    rows = _with_edges(seq).withColumn(name, F.when(at_edge, across).otherwise(beside))
    return seq.with_rows(rows.drop("_before", "_after"))


def per_entity(seq: Chunked, figures: dict[str, Column]) -> Chunked:
    """Aggregates of the whole entity on each of its rows.

    A window reuses the rows' partitioning; entities that are cut are aggregated,
    where map tasks combine, and joined.
    """
    chunk = Window.partitionBy(*seq.keys)
    rows = seq.rows.withColumns({n: f.over(chunk) for n, f in figures.items()})
    if not seq.is_cut:
        return seq.with_rows(rows)
    totals = seq.split_rows().groupBy(*seq.entity).agg(F.struct(*[f.alias(n) for n, f in figures.items()]).alias("_whole"))
    whole = {n: F.when(F.col(CHUNK) >= 0, F.col(f"_whole.{n}")).otherwise(F.col(n)) for n in figures}
    return seq.with_rows(rows.join(totals, list(seq.entity), "left").withColumns(whole).drop("_whole"))


def _dealt(seq: Chunked, rows: int) -> Chunked:
    """Deal out ``rows`` rows so that a task sorts about ROWS_IN_TASK, however few shuffle partitions are set.

    A small table is left to the exchange of the windows.
    """
    tasks = -(-rows // ROWS_IN_TASK)
    if tasks <= seq.rows.sparkSession.sparkContext.defaultParallelism:
        return seq
    # Without cuts the chunk is a constant.
    return seq.with_rows(seq.rows.repartition(tasks, *(seq.keys if seq.is_cut else seq.entity)))


def sequence_entities(
    df: DataFrame, cuts: Cuts, seq_name: str = "leg_seq", prefix: str = "prev_", rows: int = 0
) -> Chunked:
    """Number the rows of every entity and bring the carried columns of the previous row along.

    ``rows`` is how many there are, if that is known: the number of tasks grows with them.
    """
    seq = _dealt(cut_sequences(df, cuts), rows)
    window = seq.window()
    new = {seq_name: _row_number(seq)}
    at_edge = F.row_number().over(window) == 1
    for c in cuts.carry:
        before = F.lag(c).over(window)
        new[f"{prefix}{c}"] = F.when(at_edge, F.col("_before")[c]).otherwise(before) if seq.is_cut else before
    return seq.with_rows(_with_edges(seq).withColumns(new).drop("_before", "_after"))
