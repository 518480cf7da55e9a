"""Airport reference file: no header, fourteen text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlag.sources.reference import airport_overrides

# How the file marks a missing cell, and its column positions.
MISSING = "\\N"
FILE_COLUMNS = [f"c{i:02d}" for i in range(14)]
FILE_SCHEMA = ", ".join(f"{c} string" for c in FILE_COLUMNS)


def read_airport_file(spark: SparkSession, path: str) -> DataFrame:
    """Named columns of every row with a three-letter code."""
    raw = spark.read.schema(FILE_SCHEMA).options(
        header=False, mode="FAILFAST", escape='"', nullValue="", emptyValue=""
    ).csv(path)
    code = F.col("c04")
    return raw.filter(code.isNotNull() & (code != MISSING) & (F.length(code) == 3)).select(
        code.alias("airport_code"),
        F.col("c01").alias("airport_name"),
        F.col("c02").alias("city"),
        F.col("c03").alias("country"),
        F.col("c06").try_cast("double").alias("latitude"),
        F.col("c07").try_cast("double").alias("longitude"),
        F.nullif(F.col("c11"), F.lit(MISSING)).alias("timezone"),
    )


def with_overrides(airports: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """File rows plus the corrected ones, which win over rows of the same code."""
    if overrides is None:
        overrides = airport_overrides(airports.sparkSession)
    kept = airports.join(overrides.select("airport_code"), "airport_code", "left_anti")
    return overrides.unionByName(kept)


def write_airport_file(airports: DataFrame, path: str) -> None:
    """Rows in the file's layout; only the columns that are read are filled."""
    named = {
        "c01": "airport_name", "c02": "city", "c03": "country", "c04": "airport_code",
        "c06": "latitude", "c07": "longitude", "c11": "timezone",
    }
    airports.select(
        *[
            (F.coalesce(F.col(named[c]).cast("string"), F.lit(MISSING)) if c in named else F.lit("")).alias(c)
            for c in FILE_COLUMNS
        ]
    ).write.mode("overwrite").options(header=False, quoteAll=True, escape='"').csv(path)
