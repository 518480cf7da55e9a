"""The rotation kept month by month: a new month continues it, nothing old is linked again."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlag.operators.sequence import CHUNK, Chunked, Cuts, find_cuts, per_entity, sequence_entities
from flightlag.operators.turns import flyable_legs
from flightlag.plans.facts import CARRIED, SAME_WHEN_FLOWN, chain_legs, leg_order
from flightlag.settings import Settings
from flightlag.sources.tables import delete_folder, folder_exists

#: No clock is further ahead: a local day begins at most so many hours before it does in UTC.
MOST_HOURS_AHEAD = 14
TAIL = "tail_number"


class MonthlyRotation:
    """Linked legs that grow by batches of flights, each the days up to a date.

    Kept below ``root``:

    - ``legs/batch=k``: the linked legs of batch k. A cascade is *closed* once no later
      leg can join it; the legs of an aircraft's last cascade, and all legs so late that
      one of a later day may fly before them, stay *open* and are linked again by the
      next batch. Only the open legs of the last batch count.
    - ``state/batch=k``: per aircraft the numbers of closed legs and cascades and the
      columns of the last closed leg.

    A batch reads its flights, the open legs and the state; closed legs are not read.
    The state is written last, so a batch that failed counts as not there and may be
    added again. Batches come in the order of their days.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings()):
        self.spark = spark
        self.root = root.rstrip("/")
        self.settings = settings

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.root}/{kind}/batch={batch}"

    def batches(self) -> int:
        """How many batches are complete."""
        done = 0
        while folder_exists(self.spark, f"{self._path('state', done)}/_SUCCESS"):
            done += 1
        return done

    # ------------------------------------------------------------------ reading

    def _legs(self, batch: int, is_open: bool) -> DataFrame:
        rows = self.spark.read.parquet(self._path("legs", batch))
        return rows.filter(F.col("is_open") == int(is_open)).drop("is_open")

    def links(self) -> DataFrame:
        """All linked legs so far, as a rebuild from all flights would give them."""
        last = self.batches() - 1
        if last < 0:
            raise ValueError("no batch yet")
        rows = self.spark.read.option("basePath", f"{self.root}/legs").parquet(
            *[self._path("legs", k) for k in range(last + 1)]
        )
        return rows.filter((F.col("is_open") == 0) | (F.col("batch") == last)).drop("is_open", "batch")

    # ------------------------------------------------------------------- adding

    def add(self, flights: DataFrame, next_day: dt.date) -> int:
        """Link the flights before ``next_day`` that no batch had; returns how many batches there are.

        Flights of ``next_day`` and later come with later batches. As long as there was no
        leg at all there is no batch; afterwards every aircraft's last cascade is open.
        """
        batch = self.batches()
        path = self._path("legs", batch)
        linked = self.linked(flights, next_day)
        linked.hint("rebalance", "is_open", "year", "month").write.mode("overwrite").option("compression", "zstd").partitionBy(
            "is_open", "year", "month"
        ).parquet(path)
        if not folder_exists(self.spark, f"{path}/is_open=1"):
            return batch
        self._next_state(batch).write.mode("overwrite").parquet(self._path("state", batch))
        if batch and folder_exists(self.spark, f"{self._path('legs', batch - 1)}/is_open=1"):
            delete_folder(self.spark, f"{self._path('legs', batch - 1)}/is_open=1")
        return batch + 1

    def linked(self, flights: DataFrame, next_day: dt.date) -> DataFrame:
        """The legs of the batch and those left open, linked; ``is_open`` tells which may still change."""
        batch = self.batches()
        legs = flyable_legs(flights).drop(*SAME_WHEN_FLOWN)
        if batch:
            legs = legs.unionByName(self._legs(batch - 1, True).select(*legs.columns))
        cuts = find_cuts(
            legs, [TAIL], "sched_dep_utc", leg_order(self.settings), CARRIED, self.settings.max_rows_per_sequence, label="month_cuts"
        )
        seq = sequence_entities(legs, cuts)
        if batch:
            seq = self._continued(seq, self._state(batch - 1), cuts)
        seq = chain_legs(seq, self.settings)
        if batch:
            cascade = F.col("cascade_id") + F.coalesce(F.col("_state.cascades"), F.lit(0))
            seq = seq.with_rows(seq.rows.withColumn("cascade_id", cascade.cast("long")).drop("_state"))
        # Legs from here on may come after a leg of a later day.
        settled = F.lit(dt.datetime.combine(next_day, dt.time()) - dt.timedelta(hours=MOST_HOURS_AHEAD)).cast("timestamp_ntz")
        before = F.col("sched_dep_utc").cast("timestamp_ntz") < settled
        last = {"_last": F.max(F.when(before, F.col("cascade_id")))}
        rows = per_entity(seq, last).drop_chunk()
        is_open = F.coalesce(F.col("cascade_id") >= F.col("_last"), F.lit(True))
        return rows.withColumn("is_open", is_open.cast("int")).drop("_last")

    # -------------------------------------------------------------------- state

    def _state(self, batch: int) -> DataFrame:
        return self.spark.read.parquet(self._path("state", batch))

    def _next_state(self, batch: int) -> DataFrame:
        """One row per aircraft with a closed leg: what the batch closed, else as it was."""
        last = F.struct(*[F.col(c) for c in CARRIED])
        closed = self._legs(batch, False).groupBy(TAIL).agg(
            F.max("leg_seq").alias("legs"), F.max("cascade_id").alias("cascades"), F.max_by(last, F.col("leg_seq")).alias("last")
        )
        if batch == 0:
            return closed
        both = closed.unionByName(self._state(batch - 1))
        newest = F.max_by(F.struct("legs", "cascades", "last"), F.col("legs"))
        return both.groupBy(TAIL).agg(newest.alias("s")).select(TAIL, "s.*")

    def _continued(self, seq: Chunked, state: DataFrame, cuts: Cuts) -> Chunked:
        """Numbers go on from the state, and an aircraft's first leg follows its last closed one.

        The state is met by aircraft and chunk, as the windows are, so that a long
        aircraft stays cut.
        """
        known = F.struct("legs", "cascades", "last").alias("_state")
        if seq.is_cut:
            chunks = cuts.edges.select(*seq.keys).join(state, TAIL).select(*seq.keys, known)
            whole = state.join(cuts.edges.select(TAIL), TAIL, "left_anti")
            per_chunk = chunks.unionByName(whole.select(TAIL, F.lit(-1).cast("long").alias(CHUNK), known))
        else:
            per_chunk = state.select(TAIL, F.lit(-1).cast("long").alias(CHUNK), known)
        rows = seq.rows.join(per_chunk, seq.keys, "left")
        first = F.col("leg_seq") == 1
        carried = {
            f"prev_{c}": F.when(first, F.col(f"_state.last.{c}")).otherwise(F.col(f"prev_{c}")) for c in CARRIED
        }
        number = F.col("leg_seq") + F.coalesce(F.col("_state.legs"), F.lit(0))
        return seq.with_rows(rows.withColumns(carried).withColumn("leg_seq", number.cast("long")))


def rotation_by_days(
    spark: SparkSession, flights: DataFrame, starts: list[dt.date], root: str, settings: Settings = Settings()
) -> MonthlyRotation:
    """Add flights in batches: all before the second of ``starts``, then up to the next, and so on."""
    kept = MonthlyRotation(spark, root, settings)
    for first, following in zip(starts[:-1], starts[1:]):
        days = (F.col("flight_date") >= F.lit(first)) & (F.col("flight_date") < F.lit(following))
        folder = F.col("year") * 12 + F.col("month")
        months = folder.between(first.year * 12 + first.month, following.year * 12 + following.month)
        kept.add(flights.filter(days & months), following)
    return kept


def month_starts(flights: DataFrame) -> list[dt.date]:
    """First days of the months that have flights, and of the one after the last: a row per month."""
    months = [(r.year, r.month) for r in flights.select("year", "month").distinct().orderBy("year", "month").collect()]
    if not months:
        return []
    year, month = months[-1]
    return [dt.date(y, m, 1) for y, m in [*months, (year + month // 12, month % 12 + 1)]]
