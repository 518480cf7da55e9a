"""Runs of rows that continue the row before them."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from flightlag.operators.sequence import CHUNK, Chunked, Keep
from flightlag.sources.tables import keep_in_scratch


def islands(
    seq: Chunked,
    continues: Column,
    seq_name: str = "leg_seq",
    id_name: str = "island_id",
    position_name: str = "island_position",
    length_name: str = "island_length",
    keep: Keep = keep_in_scratch,
    label: str = "islands",
) -> Chunked:
    """Add the id, position and length of the run each row belongs to.

    The id counts the rows of the entity, up to and including this one, that do
    not continue; it is unique within the entity.

    A run may go on over cuts. Where there are any, rows are kept with what their chunk
    knows of its runs, and completed by one row per chunk: starts before it, and the first
    start after it. The length follows from the numbers of the run's first row and of
    the next run's first row, so a long run is never gathered in one group. Without cuts
    nothing is kept and nothing joined.
    """
    upto = seq.window().rowsBetween(Window.unboundedPreceding, 0)
    chunk = Window.partitionBy(*seq.keys)
    # Rows already come in the order of their runs, so this sort is a scan.
    run = Window.partitionBy(*seq.keys, "_starts")
    local = seq.with_rows(
        seq.rows.withColumn("_start", F.when(~continues, F.col(seq_name)))
        .withColumns({"_starts": F.count("_start").over(upto), "_first": F.max("_start").over(upto)})
        .withColumns({"_run_last": F.max(seq_name).over(run), "_chunk_last": F.max(seq_name).over(chunk)})
    )
    starts, first, end = F.col("_starts"), F.col("_first"), F.col("_chunk_last") + 1
    rows = local.rows
    if seq.is_cut:
        local = local.with_rows(keep(local.rows, label))
        rows = local.rows.join(keep(_between_chunks(local), f"{label}_chunks"), seq.keys, "left")
        starts = starts + F.coalesce(F.col("_in_starts"), F.lit(0))
        first = F.coalesce(first, F.col("_in_first"))
        # A run that ends with its chunk goes on to the next start, or to the end of its entity.
        end = F.coalesce(F.col("_in_next"), F.col("_entity_last") + 1, end)
    next_start = F.when(F.col("_run_last") < F.col("_chunk_last"), F.col("_run_last") + 1).otherwise(end)
    rows = rows.withColumns(
        {
            id_name: starts.cast("long"),
            position_name: (F.col(seq_name) - first).cast("long"),
            length_name: (next_start - first - 1).cast("long"),
        }
    )
    known = ["_start", "_starts", "_first", "_run_last", "_chunk_last"]
    return seq.with_rows(rows.drop(*known, "_in_starts", "_in_first", "_in_next", "_entity_last"))


def _between_chunks(seq: Chunked):
    """What each chunk needs to know of the others of its entity."""
    per_chunk = (
        seq.split_rows()
        .groupBy(*seq.keys)
        .agg(
            F.count("_start").alias("_c_starts"),
            F.max("_start").alias("_c_last_start"),
            F.min("_start").alias("_c_first_start"),
            F.max("_chunk_last").alias("_c_last"),
        )
    )
    chunks = Window.partitionBy(*seq.entity)
    before = chunks.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    later = chunks.orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return per_chunk.select(
        *seq.keys,
        F.sum("_c_starts").over(before).alias("_in_starts"),
        F.max("_c_last_start").over(before).alias("_in_first"),
        F.min("_c_first_start").over(later).alias("_in_next"),
        F.max("_c_last").over(chunks).alias("_entity_last"),
    )
