import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightlag.operators import scorecard as sc


@pytest.mark.parametrize("hot", [0.34, 0.9])
def test_measures_with_a_hot_key(spark, hot):
    rng = random.Random(7)
    rows = []
    for _ in range(3000):
        key = "hot" if rng.random() < hot else f"k{rng.randrange(20)}"
        rows.append((key, rng.randrange(-20, 200), rng.random() < 0.8, rng.choice("abc"), rng.randrange(100) / 100))
    df = spark.createDataFrame(rows, "k string, x int, ok boolean, c string, d double").repartition(6)
    got = {
        r.k: r
        for r in sc.scorecard(
            df,
            ["k"],
            [
                sc.rows("n"),
                sc.tally("oks", F.col("ok")),
                sc.share("ok_pct", F.col("ok")),
                sc.total("x_sum", F.col("x")),
                sc.total("d_sum", F.col("d"), places=2),
                sc.mean("x_mean", F.col("x"), F.col("ok")),
                sc.quantile("x_p90", F.col("x"), 0.9, F.col("ok")),
                sc.quantile("x_median", F.col("x"), 0.5, F.col("ok")),
                sc.distinct("kinds", F.col("c")),
                sc.largest("x_max", F.col("x")),
                sc.smallest("x_min", F.col("x")),
            ],
        ).collect()
    }
    assert set(got) == {r[0] for r in rows}
    for key, r in got.items():
        mine = [x for x in rows if x[0] == key]
        kept = [x[1] for x in mine if x[2]]
        assert (r.n, r.oks, r.x_sum) == (len(mine), len(kept), sum(x[1] for x in mine))
        assert r.ok_pct == pytest.approx(100 * len(kept) / len(mine))
        assert r.d_sum == round(sum(round(x[4] * 100) for x in mine)) / 100
        assert r.kinds == len({x[3] for x in mine})
        assert (r.x_max, r.x_min) == (max(x[1] for x in mine), min(x[1] for x in mine))
        if kept:
            assert r.x_mean == pytest.approx(statistics.fmean(kept))
            assert r.x_p90 == pytest.approx(np.quantile(kept, 0.9))
            assert r.x_median == pytest.approx(np.quantile(kept, 0.5))


def test_nothing_known_gives_null(spark):
    df = spark.createDataFrame([("a", None, False)], "k string, x int, ok boolean")
    r = sc.scorecard(
        df,
        ["k"],
        [sc.mean("m", F.col("x"), F.col("ok")), sc.quantile("q", F.col("x"), 0.9), sc.share("s", F.col("x") > 1)],
    ).first()
    assert (r.m, r.q, r.s) == (None, None, None)


def test_small_groups_are_left_out(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, x int")
    out = sc.scorecard(df, ["k"], [sc.rows("n"), sc.quantile("q", F.col("x"), 0.5)], min_rows=2)
    assert [(r.k, r.n, r.q) for r in out.collect()] == [("a", 2, 1.5)]


def test_without_keys(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    r = sc.scorecard(df, [], [sc.rows("n"), sc.mean("m", F.col("x"))]).first()
    assert (r.n, r.m) == (3, 1.5)
