"""Sequences and islands against plain Python, whole and cut into chunks."""

import datetime as dt
import pathlib
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flightlag.operators.islands import islands
from flightlag.operators.sequence import (
    cut_sequences,
    find_cuts,
    neighbour,
    number_rows,
    per_entity,
    sequence_entities,
)
from flightlag.sources.tables import keep_in_scratch

SCHEMA = "entity string, at timestamp, tie int, flag boolean"
START = dt.datetime(2024, 1, 1)


def make_rows(seed: int, n: int = 400, hot_share: float = 0.5):
    """A third and more of the rows belong to one entity; times tie often."""
    rng = random.Random(seed)
    rows = []
    for tie in range(n):
        entity = "hot" if rng.random() < hot_share else f"e{rng.randrange(12)}"
        at = START + dt.timedelta(minutes=30 * rng.randrange(160))
        rows.append((entity, at, tie, rng.random() < 0.6))
    return rows


def expected(rows):
    out = {}
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    for group in groups.values():
        group.sort(key=lambda r: (r[1], r[2]))
        flags = [bool(i and r[3]) for i, r in enumerate(group)]
        runs, start = [], 0
        for i, f in enumerate(flags):
            if not f:
                start = i
                runs.append([])
            runs[-1].append(i)
        for number, run in enumerate(runs, 1):
            for place, i in enumerate(run):
                before = group[i - 1][2] if i else None
                after = group[i + 1][2] if i + 1 < len(group) else None
                out[group[i][2]] = (i + 1, before, after, number, place, len(run) - 1, len(group))
    return out


def cuts_of(df, max_rows, **how):
    return find_cuts(df, ["entity"], "at", ["at", "tie"], ["tie"], max_rows, **how)


def computed(df, max_rows):
    seq = sequence_entities(df, cuts_of(df, max_rows), "seq", "prev_")
    seq = neighbour(seq, "tie", "next_tie", following=True)
    continues = F.col("prev_tie").isNotNull() & F.col("flag")
    seq = islands(seq, continues, "seq", "id", "place", "length")
    seq = per_entity(seq, {"size": F.count("*")})
    return seq, {
        r.tie: (r.seq, r.prev_tie, r.next_tie, r.id, r.place, r.length, r.size)
        for r in seq.drop_chunk().collect()
    }


@pytest.mark.parametrize("seed, max_rows", [(1, 10**6), (1, 40), (2, 7), (3, 1), (4, 150)])
def test_sequences_match_plain_python(spark, seed, max_rows):
    rows = make_rows(seed)
    seq, got = computed(spark.createDataFrame(rows, SCHEMA), max_rows)
    assert seq.split_rows().isEmpty() == (max_rows > 400)
    assert got == expected(rows)


def test_one_entity_holds_everything(spark):
    rows = make_rows(5, hot_share=1.0)
    seq, got = computed(spark.createDataFrame(rows, SCHEMA), 50)
    assert got == expected(rows)
    biggest = seq.rows.groupBy("_chunk").count().agg(F.max("count")).first()[0]
    assert biggest <= 50


@pytest.mark.parametrize("max_rows", [10**6, 40])
def test_tasks_grow_with_the_rows(spark, monkeypatch, max_rows):
    rows = make_rows(6)
    frame = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr("flightlag.operators.sequence.ROWS_IN_TASK", len(rows) // 40)
    cuts = cuts_of(frame, max_rows)
    numbered = sequence_entities(frame, cuts, "seq", "prev_", rows=len(rows)).drop_chunk()
    assert numbered.rdd.getNumPartitions() >= 40 > 8
    assert {r.tie: (r.seq, r.prev_tie) for r in numbered.collect()} == {t: e[:2] for t, e in expected(rows).items()}


def test_one_second_is_cut_too(spark):
    rows = [("a", START, i, i % 7 > 0) for i in range(100_000)]
    seq, got = computed(spark.createDataFrame(rows, SCHEMA), 9_000)
    sizes = [r["count"] for r in seq.rows.groupBy("_chunk").count().collect()]
    assert max(sizes) <= 9_000 and sum(sizes) == 100_000
    assert got == expected(rows)


def test_cuts_are_kept_and_used_without_a_job(spark):
    frame = spark.createDataFrame(make_rows(1), SCHEMA)
    kept = []
    cuts = cuts_of(frame, 5, keep=lambda df, name: kept.append(name) or keep_in_scratch(df, name))
    assert kept == ["cuts_long", "cuts_counts", "cuts_sides", "cuts_units", "cuts_edges"]
    context = spark.sparkContext
    context.setJobGroup("describing", "no job may start")
    neighbour(sequence_entities(frame, cuts, "seq", "prev_"), "tie", "next", following=True)
    assert len(context.statusTracker().getJobIdsForGroup("describing")) == 0
    context.setLocalProperty("spark.jobGroup.id", None)


def test_nothing_long_is_found_by_one_count_of_the_entities(spark):
    frame, kept = spark.createDataFrame(make_rows(1), SCHEMA), []
    cuts = cuts_of(frame, 10**6, keep=lambda df, name: kept.append(name) or keep_in_scratch(df, name))
    assert kept == ["cuts_long"] and cuts.units is None and cuts.edges is None


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("max_rows", [10**6, 40])
def test_one_scan_and_one_exchange_of_the_rows(spark, max_rows):
    """With and without cuts: rows are read once and dealt out once."""
    stored = keep_in_scratch(spark.createDataFrame(make_rows(6), SCHEMA), "rows")
    cuts = cuts_of(stored, max_rows)
    passed = []

    def keep(df, name):
        df.collect()
        passed.append((name, plan(df)))
        return keep_in_scratch(df, name)

    seq = neighbour(sequence_entities(stored, cuts, "seq", "prev_"), "tie", "next_tie", following=True)
    seq = islands(seq, F.col("prev_tie").isNotNull() & F.col("flag"), "seq", keep=keep)
    seq.rows.collect()
    ran = dict(passed).get("islands") or plan(seq.rows)
    path = stored.inputFiles()[0].rsplit("/", 2)[1]
    assert ran.count("FileScan") - ran.count("cuts_") == 1 and path in ran
    assert len(re.findall(r"Exchange hashpartitioning", ran)) == 1
    if max_rows == 40:
        # What completes the runs is joined to the kept rows; they are not dealt out again.
        assert "Exchange hashpartitioning" not in plan(seq.rows) and path not in plan(seq.rows)
    else:
        assert not passed and "Join" not in ran


def test_finding_a_chunk_does_not_slow_down_with_the_cuts(spark):
    """10 cuts and 10,000 cuts of one entity in a few units of time."""
    rows = spark.range(400_000).select(
        F.lit("a").alias("entity"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 40)).alias("at"),
        F.col("id").cast("int").alias("tie"),
        F.lit(True).alias("flag"),
    )
    rows = keep_in_scratch(rows.repartition(8), "rows")
    took = []
    for max_rows in (40_000, 40):
        cuts = cuts_of(rows, max_rows)
        best = 9e9
        for _ in range(3):
            start = time.perf_counter()
            cut_sequences(rows, cuts).rows.write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        took.append(best)
    assert took[1] < 4 * took[0] + 0.5


def test_no_table_is_broadcast_by_hint():
    folder = pathlib.Path(__file__).parent.parent / "flightlag/operators"
    assert not [p.name for p in folder.glob("*.py") if "broadcast(" in p.read_text()]


def test_rows_without_an_entity(spark):
    """They are one entity in windows and never cut."""
    rows = [(None, START, i, True) for i in range(20)]
    seq = sequence_entities(spark.createDataFrame(rows, SCHEMA), cuts_of(spark.createDataFrame(rows, SCHEMA), 3), "seq", "prev_")
    assert sorted(r.seq for r in seq.rows.collect()) == list(range(1, 21))


def test_long_island_crosses_chunks(spark):
    rows = [("a", START + dt.timedelta(hours=i), i, i not in (0, 70)) for i in range(100)]
    _, got = computed(spark.createDataFrame(rows, SCHEMA), 9)
    assert got == expected(rows)
    assert got[69][3:6] == (1, 69, 69) and got[99][3:6] == (2, 29, 29)


def test_islands_example(spark):
    flags = [False, False, True, True, False, True]
    rows = [("a", START + dt.timedelta(hours=i), i, f) for i, f in enumerate(flags)]
    _, got = computed(spark.createDataFrame(rows, SCHEMA), 10**6)
    assert [got[i][3] for i in range(6)] == [1, 2, 2, 2, 3, 3]
    assert [got[i][4] for i in range(6)] == [0, 0, 1, 2, 0, 1]
    assert [got[i][5] for i in range(6)] == [0, 2, 2, 2, 1, 1]


def test_empty_input(spark):
    seq, got = computed(spark.createDataFrame([], SCHEMA), 10)
    assert got == {} and seq.split_rows().isEmpty()


def test_numbers_go_on_over_chunks(spark):
    rows = [("a", START + dt.timedelta(hours=i), i, True) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    seq = cut_sequences(df, cuts_of(df, 4))
    numbers = [r.n for r in number_rows(seq, "n").rows.orderBy("tie").collect()]
    assert numbers == list(range(1, 31))
