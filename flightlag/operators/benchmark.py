"""A floor per group, taken from a wider group where the sample is thin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlag.functions.numeric import round_to


def interpolated(values: Column, p: float, weight: Column | None = None) -> Column:
    """Exact percentile, freed of the last-bit noise of its interpolation."""
    exact = F.percentile(values, p) if weight is None else F.percentile(values, p, weight)
    return round_to(exact, 9)


def benchmark_floor(
    df: DataFrame,
    value: str,
    outer: str,
    inner: str,
    p: float = 0.05,
    min_sample: int = 100,
    level_names: tuple[str, str, str] = ("carrier_airport", "carrier", "network"),
) -> DataFrame:
    """Low percentile of ``value`` by (outer, inner), else by outer, else overall.

    Rows are first counted per distinct value, where map tasks combine, so even
    a group with most of the rows reaches the percentile as a short histogram.
    """
    histogram = df.groupBy(outer, inner, value).agg(F.count("*").alias("_n"))
    levels = histogram.groupingSets(
        [[F.col(outer), F.col(inner)], [F.col(outer)], []], F.col(outer), F.col(inner)
    ).agg(
        F.grouping_id().alias("_level"),
        F.sum("_n").alias("_rows"),
        interpolated(F.col(value), p, F.col("_n")).alias("_floor"),
    )
    fine = levels.filter("_level = 0").select(
        outer, inner, F.col("_rows").alias("sample_size"), F.col("_floor").alias("_fine")
    )
    coarse = levels.filter("_level = 1").select(
        F.col(outer).alias("_outer"),
        F.col("_rows").alias("_coarse_rows"),
        F.col("_floor").alias("_coarse"),
    )
    overall = levels.filter("_level = 3").select("_floor").scalar()
    enough, enough_coarse = (
        F.col("sample_size") >= min_sample,
        F.col("_coarse_rows") >= min_sample,
    )
    fine_name, coarse_name, overall_name = level_names
    return fine.join(coarse, F.col(outer) == F.col("_outer"), "left").select(
        outer,
        inner,
        "sample_size",
        F.when(enough, F.col("_fine"))
        .when(enough_coarse, F.col("_coarse"))
        .otherwise(overall)
        .alias("floor_value"),
        F.when(enough, F.lit(fine_name))
        .when(enough_coarse, F.lit(coarse_name))
        .otherwise(F.lit(overall_name))
        .alias("benchmark_level"),
    )
