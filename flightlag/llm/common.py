"""Helpers shared by the operators: stored intermediate tables and flat text buffers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlag.session import scratch_path

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Let Python workers get few texts at a time, unless the session says how many bytes.

    A batch of 10,000 records may else hold any number of bytes, several times over in
    the executor and its worker. Results do not depend on it.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, size)


def store(df: DataFrame, label: str) -> DataFrame:
    """Write a table below the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran, not the plan above.
    Shuffle files of the write go when it has ended.
    """
    return store_at(df, scratch_path(df.sparkSession, label))


def store_at(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with _setting(spark, CLEANUP, "true"):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored table that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession):
    """``store`` for tables that nothing reads any more when the block ends: they go then."""
    paths: list[str] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        paths.append(scratch_path(spark, label))
        return store_at(df, paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            discard(spark, path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def utf8_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def unsigned_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


# ---------------------------------------------------------------- text buffers


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins; null is empty.

    The result has one more offset than rows. Bytes are not copied.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    """Row slices of about ``size`` bytes of text, at least one row each.

    Work arrays are many times the text, so a batch of 10,000 rows is cut first.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = flat_text(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(at, at[start] + size, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return LOWER[raw]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
