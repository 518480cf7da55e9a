"""Exact dedup: a stored digest index, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlag.llm.common import store
from flightlag.session import scratch_path


class DigestIndex:
    """Digests seen so far, one row each, kept as a bucketed and sorted table.

    ``append`` takes the digests of new data, reduces them to one row per digest
    with partial aggregation, drops those the index has with a sort-merge anti
    join (the index side is read by bucket, without a shuffle) and appends the rest.
    A digest keeps the id and the count of the append that brought it.

    The files stay at ``path``. A later session opens the same index by naming the
    path and the number of buckets again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64, id_type: str = "bigint"):
        self.spark = spark
        self.path = path or scratch_path(spark, "digest-index")
        self.table = f"digest_index_{uuid.uuid4().hex[:12]}"
        self.columns = f"digest STRING, keep_id {id_type}, group_size BIGINT"
        spark.sql(
            f"CREATE TABLE {self.table} ({self.columns}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def append(self, digests: DataFrame, keep_largest: bool = True) -> None:
        """Add the digests of rows (digest, doc_id) that the index does not have."""
        pick = F.max if keep_largest else F.min
        batch = digests.groupBy("digest").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        new = batch.join(self.spark.table(self.table).hint("merge"), "digest", "left_anti")
        # The reader of the table is also its writer, so the new rows are stored first.
        store(new, "new-digests").write.insertInto(self.table)

    def rows(self) -> DataFrame:
        """The index as a plain table: joins may shuffle it, and so split a hot digest."""
        return self.spark.read.schema(self.columns).parquet(self.path)

    def close(self) -> None:
        """Forget the table name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digest_of(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, lower-case hex; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def exact_groups(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of ``docs`` with the group of equal texts it belongs to.

    Equal means identical, without normalisation; null is the empty text. The row
    with the largest id stays. Rows with a null id come before all others; where
    the largest id occurs on several rows of a group, or all ids are null, each row
    with that id counts as kept. An empty table gives an empty result.

    The text is read once, only digests are stored and shuffled. The join back to
    the rows is a plain equi-join of two shuffled sides, so a digest with very many
    rows is split by adaptive execution.
    """
    digests = store(
        docs.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text)).alias("digest")), "digests"
    )
    index.append(digests)
    rows, groups = digests.alias("d"), index.rows().alias("g")
    return rows.join(groups, F.col("d.digest") == F.col("g.digest")).select(
        F.col("d.doc_id"),
        F.col("g.keep_id"),
        F.col("g.group_size"),
        F.col("d.doc_id").eqNullSafe(F.col("g.keep_id")).alias("kept"),
        F.col("d.digest").alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = DigestIndex(spark, buckets=buckets)
    groups = exact_groups(docs, index)
    index.close()
    return groups


OP3_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents),
g AS (SELECT digest, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY digest)
SELECT d.doc_id, g.keep_id, g.group_size,
       d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.digest AS text_sha256
FROM d JOIN g USING (digest)
"""
