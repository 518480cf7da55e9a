"""Points in windows of any length against plain comparison."""

import datetime as dt
import random

from flightlag.operators.periods import join_windows

START = dt.datetime(2024, 2, 28, 23, 59, 30)


def frames(spark, seed=1):
    """A third of the points share one key; lengths from a microsecond to decades."""
    rnd = random.Random(seed)
    keys = ["a", "a", "b", "c", None]
    points = [(rnd.choice(keys), i, START + dt.timedelta(seconds=rnd.randint(-10**7, 10**7), microseconds=rnd.randint(0, 3))) for i in range(300)]
    points += [("a", 300, None), ("a", 301, START)]
    lengths = [dt.timedelta(microseconds=1), dt.timedelta(minutes=1), dt.timedelta(hours=5), dt.timedelta(days=40), dt.timedelta(days=30_000)]
    windows = []
    for j in range(80):
        opens = rnd.choice(points[:300])[2] if j % 2 else START + dt.timedelta(seconds=rnd.randint(-10**7, 10**7))
        windows.append((rnd.choice(keys), j, opens, opens + lengths[j % 5]))
    windows += [("a", 80, START, START), ("a", 81, START, START - dt.timedelta(days=1)), ("a", 82, None, START), ("a", 83, START, None)]
    return points, windows


def expected(points, windows, keyed):
    return sorted(
        (p[1], w[1])
        for p in points
        for w in windows
        if None not in (p[2], w[2], w[3]) and w[2] <= p[2] < w[3] and (not keyed or (p[0] == w[0] and p[0] is not None))
    )


def test_pairs_are_those_of_comparison(spark):
    points, windows = frames(spark)
    p = spark.createDataFrame(points, "k string, i int, at timestamp")
    w = spark.createDataFrame(windows, "k string, j int, opens timestamp, closes timestamp")
    keyed = join_windows(p, "at", w, "opens", "closes", ["k"])
    assert sorted((r.i, r.j) for r in keyed.collect()) == expected(points, windows, True)
    free = join_windows(p.drop("k"), "at", w.drop("k"), "opens", "closes")
    assert sorted((r.i, r.j) for r in free.collect()) == expected(points, windows, False)


def test_longer_than_the_widest_bin_and_empty(spark):
    points, windows = frames(spark, 2)
    p = spark.createDataFrame(points, "k string, i int, at timestamp").drop("k")
    w = spark.createDataFrame(windows, "k string, j int, opens timestamp, closes timestamp").drop("k").filter("j < 82")
    found = join_windows(p, "at", w, "opens", "closes", bin_seconds=(60, 3600, 10**6))
    assert sorted((r.i, r.j) for r in found.collect()) == expected(points, windows, False)
    assert join_windows(p, "at", w.limit(0), "opens", "closes").count() == 0


def test_no_nested_loop(spark):
    points, windows = frames(spark)
    p = spark.createDataFrame(points, "k string, i int, at timestamp").drop("k")
    w = spark.createDataFrame(windows, "k string, j int, opens timestamp, closes timestamp").drop("k")
    text = join_windows(p, "at", w, "opens", "closes")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
