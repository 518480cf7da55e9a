"""Monthly delimited feed: read as text, type, store by month, top up."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlag.sources.reference import one_row
from flightlag.sources.schema import FEED_COLUMNS, FEED_SCHEMA, cast_text, text_cell
from flightlag.sources.tables import folder_exists, keep_in_scratch

ENCODING = "ISO-8859-1"


def read_text_feed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every column as text, by header, failing on malformed lines."""
    return spark.read.options(
        header=True, encoding=ENCODING, mode="FAILFAST", escape='"', enforceSchema=False
    ).csv(path)


def typed_projection(text: DataFrame, *more: str) -> DataFrame:
    """The declared columns only, each cast by its kind, and ``more`` as they are."""
    return text.select(
        *[cast_text(F.col(f"`{source}`"), kind).alias(name) for source, name, kind in FEED_COLUMNS], *more
    )


def to_text_feed(typed: DataFrame) -> DataFrame:
    """The feed's text form of typed rows; columns that are absent stay empty."""
    have = set(typed.columns)
    return typed.select(
        *[
            (text_cell(F.col(name), kind) if name in have else F.lit(None).cast("string")).alias(source)
            for source, name, kind in FEED_COLUMNS
        ]
    )


def write_text_feed(typed: DataFrame, path: str) -> None:
    to_text_feed(typed).write.mode("overwrite").options(
        header=True, encoding=ENCODING, quoteAll=True, escape='"'
    ).csv(path)


def write_months(typed: DataFrame, root: str, laid_out: bool = False) -> None:
    """Store rows in a folder per month, replacing only the months they hold.

    ``rebalance`` sizes the files: a month larger than a file is split over
    tasks, small months are not scattered. Rows that are read from a month store are
    ``laid_out``: their files have a month each, so they are written without a shuffle.
    """
    dealt = typed if laid_out else typed.hint("rebalance", "year", "month")
    (
        dealt.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("year", "month")
        .parquet(root)
    )


def read_months(spark: SparkSession, root: str) -> DataFrame:
    """All months below ``root``, none if it does not exist; year and month come from the folders."""
    if not folder_exists(spark, root):
        return spark.createDataFrame([], FEED_SCHEMA)
    return spark.read.schema(FEED_SCHEMA).parquet(root)


def month_window(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """One row per month of the inclusive window."""
    return one_row(spark).select(months_between(F.lit(first), F.lit(last)))


def months_between(first: Column, last: Column) -> Column:
    """Rows (exploded) of month starts from the month of first to that of last."""
    return F.explode(
        F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("INTERVAL 1 MONTH"))
    ).alias("month_start")


def stored_months(spark: SparkSession, root: str) -> DataFrame:
    """Months already stored, from the partition columns alone."""
    return read_months(spark, root).groupBy("year", "month").agg(F.count("*").alias("rows"))


def month_status(wanted: DataFrame, upstream: DataFrame, stored: DataFrame) -> DataFrame:
    """For each wanted month: stored already, to be ingested, or missing upstream.

    ``wanted`` has month_start; the others have year and month.
    """
    wanted = wanted.select(
        F.year("month_start").alias("year"), F.month("month_start").alias("month")
    )
    here = stored.select("year", "month", F.lit(True).alias("_stored"))
    there = upstream.select("year", "month").distinct().withColumn("_upstream", F.lit(True))
    return (
        wanted.join(here, ["year", "month"], "left")
        .join(there, ["year", "month"], "left")
        .select(
            "year",
            "month",
            F.when(F.col("_stored"), F.lit("stored"))
            .when(F.col("_upstream"), F.lit("to_ingest"))
            .otherwise(F.lit("missing"))
            .alias("status"),
        )
    )


def months_to_ingest(wanted: DataFrame, upstream: DataFrame, stored: DataFrame) -> DataFrame:
    """Wanted months that exist upstream and are not stored."""
    return month_status(wanted, upstream, stored).filter("status = 'to_ingest'").drop("status")


def ingest_new_months(typed: DataFrame, wanted_months: DataFrame, root: str, laid_out: bool = False) -> None:
    """Store the rows of the given months; other stored months stay as they are."""
    if laid_out:
        # A stored table is known to be short, so the rows stay where they are in the join.
        wanted_months = keep_in_scratch(wanted_months, "wanted-months")
    write_months(typed.join(wanted_months, ["year", "month"], "left_semi"), root, laid_out)


def empty_months(spark: SparkSession) -> DataFrame:
    return one_row(spark).filter("id < 0").select(
        F.col("id").cast("int").alias("year"), F.col("id").cast("int").alias("month")
    )
