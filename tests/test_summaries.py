"""Scorecards from summaries, and the rotation grown by batches."""

import dataclasses
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from flightlag.operators import scorecard as sc
from flightlag.operators.filters import Slice
from flightlag.operators.summary import Source, Summary
from flightlag.plans import explore, facts
from flightlag.plans.catalog import FEED_SETTINGS, NARROWED, WEEK, inputs
from flightlag.plans.rotation_months import MonthlyRotation, month_starts, rotation_by_days
from flightlag.sources.tables import delete_folder, keep_in_scratch


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    columns = sorted(a.columns)
    a, b = a.select(columns), b.select(columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def wh(spark, sf_dir):
    return inputs(spark, sf_dir).warehouse()


def measures():
    known = F.col("flag").isNotNull()
    return [
        sc.rows("rows"),
        sc.total("total", F.col("x")),
        sc.share("share", F.col("flag"), 2),
        sc.mean("mean", F.col("x"), F.col("flag")),
        sc.mean("exact", F.col("y"), places=2),
        sc.quantile("median", F.col("x"), 0.5),
        sc.quantile("p90", F.col("x"), 0.9, known),
        sc.quantile("low", F.col("z"), 0.1),
        sc.largest("most", F.col("x")),
        sc.smallest("least", F.col("z")),
    ]


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows share one key; every column may be null."""
    rnd = random.Random(4)

    def maybe(value):
        return None if rnd.random() < 0.1 else value

    made = [
        (maybe(rnd.choice("aab")), maybe(rnd.choice("pqr")), maybe(rnd.randint(-9, 30)), rnd.randint(0, 999) / 100, maybe(rnd.random() < 0.4), maybe(rnd.randint(0, 5)))
        for _ in range(900)
    ]
    return spark.createDataFrame(made, "k string, l string, x int, y double, flag boolean, z int")


@pytest.mark.parametrize("keys", [[], ["k"], ["l", "k"]])
def test_a_summary_tells_what_the_rows_tell(rows, keys):
    summary = Summary(("k", "l"), tuple(measures()))
    built = keep_in_scratch(summary.build(rows), "summary")
    assert same(summary.answer(built, keys, measures()), sc.scorecard(rows, keys, measures()))
    few = measures()[:3]
    assert same(summary.answer(built, keys, few, 200), sc.scorecard(rows, keys, few, 200))


def test_other_quantiles_of_a_kept_input(rows):
    summary = Summary(("k",), (sc.quantile("median", F.col("x"), 0.5),))
    wanted = [sc.quantile(f"p{p}", F.col("x"), p / 100) for p in (1, 25, 99)]
    assert summary.fits(["k"], wanted)
    assert same(summary.answer(summary.build(rows), ["k"], wanted), sc.scorecard(rows, ["k"], wanted))


def test_what_a_summary_cannot_tell_comes_from_the_rows(rows):
    summary, read = Summary(("k",), (sc.rows("n"), sc.total("t", F.col("x")))), []

    def look(what):
        def table():
            read.append(what)
            return rows if what == "fact" else summary.build(rows)

        return table

    source = Source(look("fact"), summary, look("summary"))
    source.figures(Slice(), ["k"], [sc.total("other name", F.col("x"))])
    source.figures(Slice(), ["l"], [sc.rows("n")])
    source.figures(Slice(), ["k"], [sc.distinct("n", F.col("x"))])
    source.figures(Slice(), ["k"], [sc.mean("m", F.col("x"))])
    assert read == ["summary", "fact", "fact", "fact"]


def test_an_empty_slice(rows):
    summary = Summary(("k", "l"), tuple(measures()))
    none = summary.answer(summary.build(rows).filter("k = 'none'"), [], measures()).first()
    assert none["rows"] == 0 and none["median"] is None and none["total"] is None


@pytest.mark.parametrize("where", [WEEK, Slice(airports=("SEA", "ATL"))])
def test_filters_agree_with_the_facts(wh, where):
    assert same(explore.filtered_kpis(wh.flight_days(), where, wh.cost()), explore.filtered_kpis(wh.flight(), where, wh.cost()))
    assert same(explore.filtered_trend(wh.flight_days(), where), explore.filtered_trend(wh.flight(), where))
    by_summary = explore.damage_vs_repair(wh.cascade_hours(), wh.turn_hours(), where)
    assert same(by_summary, explore.damage_vs_repair(wh.cascade(), wh.rotation_leg(), where))


def test_filters_read_the_summaries_only(wh):
    for df in (
        explore.filtered_kpis(wh.flight_days(), WEEK, wh.cost()),
        explore.filtered_trend(wh.flight_days(), NARROWED),
        explore.damage_vs_repair(wh.cascade_hours(), wh.turn_hours(), WEEK),
    ):
        text = plan(df)
        assert "sum_" in text and "fct_flight" not in text and "int_rotation_leg" not in text and "mart_cascade" not in text
        assert text.count("Exchange") <= 4
    assert "PartitionFilters: [isnotnull(year" in plan(explore.filtered_trend(wh.flight_days(), WEEK))


# ------------------------------------------------------------ month by month


def linked(wh):
    return facts.rotation_links(wh.flight(), wh.settings, wh.rotation_cuts())


def test_batches_give_the_rebuild(spark, wh, tmp_path):
    first, *_, end = month_starts(wh.flight())
    starts = [*(first + dt.timedelta(days=n) for n in range(25, (end - first).days, 12)), end]
    kept = rotation_by_days(spark, wh.flight(), [first, *starts], str(tmp_path / "rotation"), wh.settings)
    assert kept.batches() > 2
    assert same(kept.links(), linked(wh))


def test_batches_of_a_long_aircraft(spark, sf_dir, tmp_path):
    """A third of all legs flown by one aircraft, cut within every batch."""
    x = inputs(spark, sf_dir)
    settings = dataclasses.replace(FEED_SETTINGS, max_rows_per_sequence=40)
    hot = F.when(F.col("event_id") % 3 == 0, F.lit("N999")).otherwise(F.col("tail_number"))
    flights = keep_in_scratch(x.warehouse().flight().withColumn("tail_number", hot), "hot-flights")
    first, *_, end = month_starts(flights)
    days = [first, dt.date(2024, 1, 6), dt.date(2024, 1, 15), dt.date(2024, 1, 16), end]
    kept = rotation_by_days(spark, flights, days, str(tmp_path / "rotation"), settings)
    assert same(kept.links(), facts.rotation_links(flights, settings))


def test_a_month_reads_the_state_and_itself(spark, wh, tmp_path):
    months = month_starts(wh.flight())
    root = str(tmp_path / "rotation")
    rotation_by_days(spark, wh.flight(), months[:-1], root, wh.settings)
    later = wh.flight().filter((F.col("year") == months[-2].year) & (F.col("month") == months[-2].month))
    text = plan(MonthlyRotation(spark, root, wh.settings).linked(later, months[-1]))
    assert "legs/batch=0" in text and "is_open" in text and "state/batch=0" in text
    legs_scan = next(line for line in text.split("\n") if "legs/batch=0" in line)
    assert "PartitionFilters: [isnotnull(is_open" in legs_scan and "is_open" in legs_scan


def test_a_batch_that_failed_is_added_again(spark, wh, tmp_path, monkeypatch):
    """Its legs lie there without a state: they do not count, and are replaced."""
    months, root = month_starts(wh.flight()), str(tmp_path / "rotation")
    kept = rotation_by_days(spark, wh.flight(), months[:-1], root, wh.settings)
    before, rows = kept.batches(), kept.links().count()
    later = wh.flight().filter((F.col("year") == months[-2].year) & (F.col("month") == months[-2].month))
    with monkeypatch.context() as broken:
        broken.setattr(MonthlyRotation, "_next_state", lambda self, batch: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            kept.add(later, months[-1])
    again = MonthlyRotation(spark, root, wh.settings)
    assert (again.batches(), again.links().count()) == (before, rows)
    assert again.add(later, months[-1]) == before + 1
    assert same(again.links().select("event_id", "leg_seq", "cascade_length"), linked(wh).select("event_id", "leg_seq", "cascade_length"))
