"""Monthly files picked up as they land."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flightlag.session import scratch_path
from flightlag.sources.raw_feed import ENCODING, read_months, read_text_feed, typed_projection, write_months
from flightlag.sources.schema import FEED_COLUMNS, FEED_SCHEMA
from flightlag.sources.tables import delete_folder, folder_exists, place_small, read_small

TEXT_SCHEMA = T.StructType([T.StructField(source, T.StringType()) for source, _, _ in FEED_COLUMNS])


#: The column that says which file a row came from.
LANDED_FILE = "landed_file"


def text_schema(spark: SparkSession, sample: str) -> T.StructType:
    """The columns of a feed file, all text, from its header line."""
    return read_text_feed(spark, sample).schema


def watch_landing(spark: SparkSession, landing: str, schema: T.StructType = TEXT_SCHEMA) -> DataFrame:
    """Typed rows of files that appear below ``landing``.

    ``schema`` names all columns of the files, of which the declared are kept.
    """
    text = (
        spark.readStream.schema(schema)
        .options(header=True, encoding=ENCODING, mode="FAILFAST", escape='"', enforceSchema=False)
        .csv(landing)
        .select("*", F.col("_metadata.file_path").alias(LANDED_FILE))
    )
    return typed_projection(text, LANDED_FILE)


def ingest_landing(typed: DataFrame, root: str, checkpoint: str, ledger: str | None = None) -> StreamingQuery:
    """Store what has landed since the last run, then stop.

    ``typed`` is what ``watch_landing`` gives. The months a batch touches are read, joined by
    the new rows and replaced by the writer that batches use, so both may share a store, and
    rows that repeat within a file stay as they do there. ``Ledger`` says which files count.
    """

    def merge(batch: DataFrame, number: int) -> None:
        Ledger(batch.sparkSession, ledger or f"{root.rstrip('/')}-ledger").land(batch, number, root)

    return (
        typed.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class Ledger:
    """Which files a month store holds: batch, file, rows and digests of its rows.

    A file with the rows of one that was landed before, under whatever name, is that one
    again and adds nothing; so is a batch that is repeated. A batch first lays out the
    months as they will be and notes that it did; then the months are replaced and the batch is
    noted as done. Repeated after a failure it goes on with what is laid out, so each of
    its rows is there once, wherever it was stopped. One batch may run at a time, and no
    other writer beside it.
    """

    FILES = f"{LANDED_FILE} string, rows long, total decimal(38,0), mixed long, batch string"
    DIGEST = ("rows", "total", "mixed")

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def files(self) -> DataFrame:
        """One row per file that counts."""
        path = f"{self.root}/files"
        if not folder_exists(self.spark, path):
            return self.spark.createDataFrame([], self.FILES)
        return self.spark.read.schema(self.FILES).parquet(path)

    def land(self, batch: DataFrame, number: int, root: str) -> None:
        """Add a batch of rows with their files to the months below ``root``."""
        landed_path, new_path = scratch_path(self.spark, "landed"), scratch_path(self.spark, "landed-files")
        batch.write.parquet(landed_path)
        landed = self.spark.read.schema(batch.schema).parquet(landed_path)
        files = self._digests(landed)
        # The number alone would mix up a checkpoint with one that was begun anew.
        names = files.agg(F.sum(F.xxhash64(LANDED_FILE, *self.DIGEST).cast("decimal(20,0)")).alias("names")).first()
        key = f"{number:08d}-{names['names'] or 0}"
        if not folder_exists(self.spark, self._note("done", key)):
            if not folder_exists(self.spark, self._note("laid-out", key)):
                known = self.files().where(F.col("batch") != key)
                new = files.join(known, list(self.DIGEST), "left_anti").dropDuplicates(list(self.DIGEST))
                new.withColumn("batch", F.lit(key)).write.parquet(new_path)
                added = self.spark.read.schema(self.FILES).parquet(new_path)
                # A batch of known files changes no month.
                if not added.isEmpty():
                    self._lay_out(key, landed, added, root)
            if folder_exists(self.spark, self._note("laid-out", key)):
                laid_out = read_small(self.spark, self._note("laid-out", key))
                write_months(self.spark.read.schema(FEED_SCHEMA).parquet(laid_out), root)
                place_small(self.spark, self._note("done", key), "")
                delete_folder(self.spark, laid_out)
            else:
                place_small(self.spark, self._note("done", key), "")
        delete_folder(self.spark, landed_path)
        delete_folder(self.spark, new_path)

    def _note(self, what: str, key: str) -> str:
        return f"{self.root}/{what}/{key}"

    def _digests(self, landed: DataFrame) -> DataFrame:
        """Rows and order-free sums of hashes per file, combined in the tasks that read it."""
        value = F.xxhash64(*[F.col(c) for c in landed.columns if c != LANDED_FILE])
        return landed.groupBy(LANDED_FILE).agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(value.cast("decimal(20,0)")).cast("decimal(38,0)").alias("total"),
            F.bit_xor(F.xxhash64(value)).alias("mixed"),
        )

    def _lay_out(self, key: str, landed: DataFrame, new: DataFrame, root: str) -> None:
        """Write the months of the new files as they will be, note the files, then that this is done."""
        rows = landed.join(new.select(LANDED_FILE), LANDED_FILE, "left_semi").drop(LANDED_FILE)
        stored = read_months(self.spark, root)
        touched = stored.join(rows.select("year", "month").distinct(), ["year", "month"], "left_semi")
        path = f"{self.root}/months/{key}-{uuid.uuid4().hex[:12]}"
        rows.unionByName(touched).select(*stored.columns).write.parquet(path)
        new.write.mode("overwrite").parquet(f"{self.root}/files/key={key}")
        place_small(self.spark, self._note("laid-out", key), path)
