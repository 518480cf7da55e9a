"""Exact quantiles by selection against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flightlag.operators.quantile import exact_quantiles
from flightlag.sources.tables import keep_in_scratch

PS = {"low": 0.0, "p05": 0.05, "median": 0.5, "p90": 0.9, "most": 1.0}


def by_sorting(values, p):
    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    place = p * (len(values) - 1)
    low, high = values[math.floor(place)], values[math.ceil(place)]
    return float(low + (high - low) * (place - math.floor(place)))


def check(found, rows):
    groups = {}
    for key, value in rows:
        groups.setdefault(key, []).append(value)
    assert {r["k"] for r in found} == set(groups) and len(found) == len(groups)
    for r in found:
        assert r["known"] == sum(v is not None for v in groups[r["k"]])
        for name, p in PS.items():
            want = by_sorting(groups[r["k"]], p)
            assert r[name] == want or r[name] == pytest.approx(want, rel=1e-12)


def test_whole_numbers_of_any_size(spark):
    """A third of the rows have one key; some keys are null, some groups have no value."""
    rnd = random.Random(2)
    sizes = [lambda: rnd.randint(-5, 5), lambda: rnd.randint(-(2**40), 2**40), lambda: 7, lambda: 65_536 * rnd.randint(-3, 3)]
    rows = [(rnd.choice(["a", "a", "b", "c", None]), rnd.choice(sizes)()) for _ in range(3_000)]
    rows += [("a", None), ("none", None), ("none", None), ("one", -1), ("edge", 2**63 - 1), ("edge", 2**63 - 1), ("low", -(2**63))]
    df = spark.createDataFrame(rows, "k string, v long").repartition(7)
    check(exact_quantiles(df, ["k"], F.col("v"), PS).collect(), rows)


def test_decimals_and_no_keys(spark):
    rnd = random.Random(3)
    rows = [(None, rnd.randint(-10**7, 10**7) / 100) for _ in range(2_000)]
    df = spark.createDataFrame([(v,) for _, v in rows], "v double")
    found = exact_quantiles(df, [], F.col("v"), PS, places=2).first()
    for name, p in PS.items():
        assert found[name] == pytest.approx(by_sorting([v for _, v in rows], p), abs=1e-9)
    assert exact_quantiles(df.limit(0), ["v"], F.col("v"), PS, places=2).collect() == []


def test_no_task_gathers_values(spark):
    """Rows reach the counts by a partial aggregate, and nothing collects or sorts values."""
    df = spark.range(100_000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7_919).alias("v"))
    df, plans = keep_in_scratch(df, "wide"), []

    def keep(found, label):
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return keep_in_scratch(found, label)

    exact_quantiles(df, ["k"], F.col("v"), {"median": 0.5}, keep=keep).collect()
    assert len(plans) == 5
    for text in plans:
        assert "percentile" not in text and "ObjectHashAggregate" not in text
        assert text.count("FileScan") == 0 or "partial_count" in text or "quantile" in text
