"""The models in their order, each built once on first use."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlag.operators.sequence import Cuts
from flightlag.operators.summary import Source, Summary
from flightlag.plans import dimensions, explore, facts, marts, staging, summaries
from flightlag.session import pin_session, scratch_path
from flightlag.settings import Settings
from flightlag.sources.airports import with_overrides
from flightlag.sources.raw_feed import read_months
from flightlag.sources.reference import cost_assumptions, cost_per_minute, inline_table, one_row
from flightlag.sources.tables import TableStore, content_id, files_id

#: Raised whenever a model is computed otherwise than before: stored tables of an older number are replaced.
MODELS = 1


@dataclass(frozen=True)
class Figures:
    """Rows of a model and, per column, its type and the values that are not null."""

    rows: int
    columns: list[tuple[str, str, int]]


class Warehouse:
    """Models over a typed feed and an airport table.

    ``feed`` is the root of a month store, which is read where it lies, or a
    DataFrame, which may be costly to compute and is stored once.

    Every model is written as parquet below ``root`` (by default a fresh folder
    in the shared directory of the session) and read back, so later models start
    from stored data: a lost executor costs the running stage only, and Spark
    knows table sizes when it chooses joins.

    Below a given ``root`` a later session finds the models again, if they were made
    with the same settings from the same inputs: the files of the month store, the rows
    of the airport table. A DataFrame as feed is told by ``feed_id``, a name the caller
    gives its content; without one its models are built anew.
    """

    def __init__(
        self,
        spark: SparkSession,
        feed: DataFrame | str,
        airports: DataFrame,
        settings: Settings = Settings(),
        root: str | None = None,
        calendar_span: tuple | None = None,
        feed_id: str | None = None,
    ):
        self.spark = pin_session(spark)
        self.settings = settings
        self.seconds: dict[str, float] = {}
        self._feed = feed
        self._airports = airports
        self._span = calendar_span
        self._cuts: Cuts | None = None
        inputs = self._inputs(feed_id) if root else ""
        self.store = TableStore(spark, root or scratch_path(spark, "warehouse"), inputs)

    def _inputs(self, feed_id: str | None) -> str:
        """What the models are made from, in one name."""
        feed = files_id(self.spark, self._feed) if isinstance(self._feed, str) else feed_id or uuid.uuid4().hex
        made_from = [MODELS, asdict(self.settings), self._span, feed, content_id(self._airports)]
        return hashlib.sha256(json.dumps(made_from, default=str).encode()).hexdigest()

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return self.store.save(name, df)

    def _table(
        self, name: str, plan: Callable[[], DataFrame], by: tuple[str, ...] = (), compact: bool = False
    ) -> DataFrame:
        if not self.store.has(name):
            self.store.save(name, plan(), by, compact)
            self.seconds[name] = self.store.version(name).seconds
        return self.store.load(name)

    # ------------------------------------------------------------ inputs

    def feed(self) -> DataFrame:
        """The typed feed by month."""
        if isinstance(self._feed, str):
            return read_months(self.spark, self._feed)
        return self._table("feed", lambda: self._feed, ("year", "month"), compact=True)

    def _feed_once(self) -> DataFrame:
        """The typed feed for one reading: what is not stored yet is not stored for it."""
        return self.feed() if isinstance(self._feed, str) or self.store.has("feed") else self._feed

    def stg_airport(self) -> DataFrame:
        return self._table("stg_airport", lambda: with_overrides(self._airports))

    def stg_flight(self) -> DataFrame:
        """A view: only the flight fact reads it."""
        return staging.stg_flight(
            self.feed(), self.stg_airport(), self.settings.clock, self.zone_offsets()
        )

    def zone_offsets(self) -> DataFrame:
        """Clock offsets of the zones in use, over the days of the feed.

        Two days more, as a departure at 2400 or with a rounded hour is on the next.
        """

        def plan() -> DataFrame:
            codes = self.airport_activity().select("airport_code")
            used = self.stg_airport().join(codes, "airport_code", "left_semi")
            span = self.feed().agg(
                F.min("flight_date").alias("first_day"),
                F.date_add(F.max("flight_date"), 2).alias("last_day"),
            )
            first, last = (span.select(c).scalar() for c in span.columns)
            return staging.zone_offsets(used, first, last)

        return self._table("zone_offsets", plan)

    def cost_assumptions(self) -> DataFrame:
        return cost_assumptions(self.spark)

    def cost(self) -> Column:
        return cost_per_minute(self.cost_assumptions(), self.settings.cost_assumption)

    # ------------------------------------------------------- dimensions

    def airport_activity(self) -> DataFrame:
        return self._table(
            "airport_activity", lambda: dimensions.airport_activity(self.feed())
        )

    def dim_airport(self) -> DataFrame:
        return self._table(
            "dim_airport",
            lambda: dimensions.dim_airport(self.airport_activity(), self.stg_airport()),
        )

    def dim_carrier(self) -> DataFrame:
        return self._table(
            "dim_carrier", lambda: dimensions.dim_carrier(self.feed())
        )

    def days(self) -> DataFrame:
        if self._span is not None:
            first, last = self._span
            span = one_row(self.spark).select(
                F.lit(first).cast("date").alias("first_day"), F.lit(last).cast("date").alias("last_day")
            )
        else:
            span = self.feed().agg(
                F.min("flight_date").alias("first_day"), F.max("flight_date").alias("last_day")
            )
        return dimensions.calendar(span)

    def dim_date(self) -> DataFrame:
        return self._table("dim_date", lambda: dimensions.dim_date(self.days()))

    # ------------------------------------------------------------- facts

    def flight(self) -> DataFrame:
        return self._table(
            "fct_flight",
            lambda: facts.fct_flight(self.stg_flight(), self.settings),
            ("year", "month"),
        )

    def flight_once(self, instants: bool = True) -> DataFrame:
        """The flight fact for one reading: as stored or else, being row-wise, as it is read.

        Then nothing is written for it, and only what is asked for is worked out. ``instants``
        says whether columns of instants are asked for: these need the table of clock offsets,
        and that the stored feed. They are right without, but zone rules are looked up per flight.
        """
        if self.store.has("fct_flight"):
            return self.flight()
        if instants:
            return facts.fct_flight(self.stg_flight(), self.settings)
        staged = staging.stg_flight(self._feed_once(), self.stg_airport(), self.settings.clock)
        return facts.fct_flight(staged, self.settings)

    def rotation_cuts(self) -> Cuts:
        """Where very long sequences are cut: small tables, found once."""
        if self._cuts is None:
            self._cuts = facts.rotation_cuts(self.flight(), self.settings, self._keep)
        return self._cuts

    def rotation_links(self) -> DataFrame:
        """Linked legs by month: one shuffle by aircraft, one to lay out the files."""
        links = self._table(
            "int_rotation_leg",
            lambda: facts.rotation_links(
                self.flight(), self.settings, self.rotation_cuts(), self._keep, self.row_count("fct_flight")
            ),
            ("year", "month"),
            compact=True,
        )
        for name in ("rotation_islands", "rotation_islands_chunks"):
            self.store.remove(name)
        return links

    def min_turn(self) -> DataFrame:
        return self._table(
            "ref_min_turn",
            lambda: facts.ref_min_turn(self.rotation_links(), self.settings),
        )

    def rotation_leg(self) -> DataFrame:
        """A view: stored links joined to the short floor table, without a shuffle."""
        return facts.fct_rotation_leg(self.rotation_links(), self.min_turn())

    # ------------------------------------------------------------- marts

    def carrier_monthly(self) -> DataFrame:
        return self._table(
            "mart_carrier_monthly",
            lambda: marts.mart_carrier_monthly(self.flight(), self.dim_carrier()),
        )

    def airport_daily(self) -> DataFrame:
        return self._table(
            "mart_airport_daily",
            lambda: marts.mart_airport_daily(self.flight(), self.dim_airport(), self.dim_date()),
        )

    def route_reliability(self) -> DataFrame:
        return self._table(
            "mart_route_reliability",
            lambda: marts.mart_route_reliability(
                self.flight(), self.dim_airport(), self.dim_carrier(), self.settings.route_min_flights
            ),
        )

    def cascade(self) -> DataFrame:
        return self._table(
            "mart_cascade",
            lambda: marts.mart_cascade(
                self.rotation_links(), self.dim_carrier(), self.cost(), self.settings
            ),
        )

    def turn_slack_opportunity(self) -> DataFrame:
        return self._table(
            "mart_turn_slack_opportunity",
            lambda: marts.mart_turn_slack_opportunity(
                self.rotation_leg(), self.dim_airport(), self.dim_carrier(), self.cost(), self.settings
            ),
        )

    # --------------------------------------------------------- summaries

    def _summarised(self, name: str, summary: Summary, rows: Callable[[], DataFrame], airport: str = "origin") -> Source:
        by = tuple(c for c in ("year", "month") if c in summary.dims)
        table = lambda: self._table(name, lambda: summary.build(rows()), by, compact=True)
        return Source(rows, summary, table, airport)

    def flight_days(self) -> Source:
        """The flight fact with its figures by carrier, origin and day."""
        return self._summarised("sum_flight_day", summaries.flight_days(), self.flight)

    def cascade_hours(self) -> Source:
        """Cascades with their figures by carrier, root station, day and hour."""
        rows = lambda: explore.roots_by_hour(self.cascade())
        return self._summarised("sum_cascade_hour", summaries.cascade_hours(), rows, "root_origin")

    def turn_hours(self) -> Source:
        """Turns with their figures by carrier, station, day and hour."""
        rows = lambda: explore.turns_by_hour(self.rotation_leg())
        return self._summarised("sum_turn_hour", summaries.turn_hours(self.settings), rows)

    def models(self) -> dict[str, Callable[[], DataFrame]]:
        return {
            "stg_airport": self.stg_airport,
            "stg_flight": self.stg_flight,
            "dim_airport": self.dim_airport,
            "dim_carrier": self.dim_carrier,
            "dim_date": self.dim_date,
            "fct_flight": self.flight,
            "int_rotation_leg": self.rotation_links,
            "ref_min_turn": self.min_turn,
            "fct_rotation_leg": self.rotation_leg,
            "ref_cost_assumption": self.cost_assumptions,
            "mart_carrier_monthly": self.carrier_monthly,
            "mart_airport_daily": self.airport_daily,
            "mart_route_reliability": self.route_reliability,
            "mart_cascade": self.cascade,
            "mart_turn_slack_opportunity": self.turn_slack_opportunity,
        }

    def materialise(self) -> None:
        """Write every stored model; those of a group do not need each other, so
        their jobs are submitted together and fill each other's idle cores."""
        groups = [
            [self.feed],
            [self.stg_airport, self.airport_activity, self.dim_carrier, self.dim_date],
            [self.zone_offsets, self.dim_airport],
            [self.flight],
            [self.rotation_links, self.carrier_monthly, self.airport_daily, self.route_reliability],
            [self.min_turn],
            [self.cascade, self.turn_slack_opportunity],
        ]
        for group in groups:
            with ThreadPoolExecutor(len(group)) as pool:
                for done in [pool.submit(model) for model in group]:
                    done.result()

    def _noted(self, name: str) -> Figures:
        """Figures of a stored model, as counted when it was written."""
        df, version = self.models()[name](), self.store.version(name)
        return Figures(version.rows, [(f.name, f.dataType.simpleString(), version.filled[f.name]) for f in df.schema])

    def _viewed(self, df: DataFrame, base: Figures | None = None) -> Figures:
        """Figures of a view with the rows of ``base``: only columns that ``base`` lacks are read."""
        known = {name: filled for name, _, filled in base.columns} if base else {}
        counts = [F.count(F.col(f"`{c}`")).alias(c) for c in df.columns if c not in known]
        if base is None:
            counts.append(F.count(F.lit(1)).alias("_rows"))
        found = {**known, **(df.agg(*counts).first().asDict() if counts else {})}
        rows = base.rows if base else found["_rows"]
        return Figures(rows, [(f.name, f.dataType.simpleString(), found[f.name]) for f in df.schema])

    def figures(self) -> dict[str, Figures]:
        """Rows and filled values of every model; stored models are not read for it.

        The views have the rows of the fact that is made from them or that they complete,
        and share its columns by name; what else they have is counted in one pass each.
        """
        views = {
            "stg_flight": lambda: self._viewed(self.stg_flight(), self._noted("fct_flight")),
            "fct_rotation_leg": lambda: self._viewed(self.rotation_leg(), self._noted("int_rotation_leg")),
            "ref_cost_assumption": lambda: self._viewed(self.cost_assumptions()),
        }
        return {name: views[name]() if name in views else self._noted(name) for name in self.models()}

    def row_count(self, name: str) -> int:
        """Rows of a model as counted by its write; one that is not built yet is read."""
        same = {"stg_flight": "fct_flight", "fct_rotation_leg": "int_rotation_leg"}.get(name, name)
        version = self.store.version(same)
        return version.rows if version else self.models()[name]().count()

    def build(self) -> DataFrame:
        """Build every model; returns (model, rows, seconds).

        Rows are those counted while writing. Seconds are those of the write, by whichever
        session; views have none.
        """
        self.materialise()
        stored = {name: self.store.version(name) for name in self.models()}
        log = [(name, self.row_count(name), v and v.seconds) for name, v in stored.items()]
        return inline_table(self.spark, log, "model string, rows long, seconds double")

    def close(self) -> None:
        """Remove the model tables; a month store given as feed stays."""
        self.store.drop()

    def register(self, prefix: str = "") -> None:
        """Name every model for SQL."""
        for name, model in self.models().items():
            model().createOrReplaceTempView(prefix + name)
