import pytest
from pyspark.sql import functions as F

from flightlag.functions.labels import cancellation_reason, primary_cause, size_band
from flightlag.functions.numeric import open_bucket, pearson, ratio, round_to
from flightlag.operators.delay import attribution_flags, split_root_inherited

CAUSES = "carrier_delay int, weather_delay int, nas_delay int, security_delay int, late_aircraft_delay int"


def one(spark, row, schema, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


@pytest.mark.parametrize(
    "row, cause",
    [
        ((None,) * 5, None),
        ((0, 0, 0, 0, 0), "None reported"),
        ((20, 0, 0, 0, 20), "Carrier"),
        ((0, 0, 15, 0, 15), "Late aircraft"),
        ((0, 15, 15, 0, 0), "National Air System"),
        ((0, 15, 0, 15, 0), "Weather"),
        ((0, 0, 0, 16, 1), "Security"),
        ((1, 2, 3, 4, 5), "Late aircraft"),
    ],
)
def test_primary_cause(spark, row, cause):
    assert one(spark, row, CAUSES, primary_cause().alias("c")).c == cause


def test_split_counts_missing_causes_as_nothing(spark):
    names = ["carrier_delay", "weather_delay", "nas_delay", "security_delay", "late_aircraft_delay"]
    df = spark.createDataFrame([(None,) * 5, (10, 2, 3, 0, 7), (0, 0, 0, 0, 0)], CAUSES)
    out = attribution_flags(split_root_inherited(df), names, "late_aircraft_delay")
    got = [
        (r.root_delay_minutes, r.inherited_delay_minutes, r.controllable_root_minutes,
         r.external_root_minutes, r.has_cause_attribution, r.has_complete_attribution)
        for r in out.collect()
    ]
    assert got == [(0, 0, 0, 0, False, False), (15, 7, 10, 5, True, True), (0, 0, 0, 0, True, False)]


def test_codes(spark):
    df = spark.createDataFrame([("A",), ("B",), ("C",), ("D",), ("X",), (None,)], "c string")
    got = [r.r for r in df.select(cancellation_reason(F.col("c")).alias("r")).collect()]
    assert got == ["Carrier", "Weather", "National Air System", "Security", None, None]


def test_size_bands_include_their_bounds(spark):
    df = spark.createDataFrame([(0.01,), (0.0099,), (0.0025,), (0.0005,), (0.0004,), (None,)], "s double")
    got = [r.b for r in df.select(size_band(F.col("s")).alias("b")).collect()]
    assert got == ["Large", "Medium", "Medium", "Small", "Non-hub", "Non-hub"]


def test_rounding_and_guards(spark):
    r = spark.range(1).select(
        round_to(F.lit(1.005), 2).alias("a"),
        round_to(F.lit(2.5), 0).alias("b"),
        ratio(F.lit(1), F.lit(0)).alias("c"),
    ).first()
    assert (r.a, r.b, r.c) == (1.0, 3.0, None)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert flat.agg(pearson(F.col("x"), F.col("y")).alias("r")).first().r is None


def test_open_bucket(spark):
    df = spark.createDataFrame([(0.0,), (14.9,), (15.0,), (89.0,), (90.0,), (500.0,)], "x double")
    assert [r.b for r in df.select(open_bucket(F.col("x"), 15, 90).alias("b")).collect()] == [
        0, 0, 15, 75, 90, 90,
    ]
