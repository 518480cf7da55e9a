"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlag.llm.common import discard, store_at
from flightlag.session import scratch_path


def _state(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def _large_star(links: DataFrame, scratch: str) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = store_at(least, scratch)
    met = both.join(least, "u").where(F.col("v") > F.col("u"))
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame, scratch: str) -> DataFrame:
    least = store_at(links.groupBy("u").agg(F.min("v").alias("m")), scratch)
    met = links.join(least, "u")
    onward = met.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return onward.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(u, root) for every node of ``links`` (u, v) that is not its component's least node.

    Alternating stars: each node's neighbours are hung on the least of them, first
    above, then below the node, until nothing changes. Every round is written to the
    shared folder, the one before is removed. A node with very many neighbours is
    aggregated before the shuffle; the result is stored, so that the join is one of
    two plain shuffles and adaptive execution can split that node. Links to oneself and
    repeated links do no harm; no links give no rows.
    """
    spark = links.sparkSession
    ordered = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    path = scratch_path(spark, "stars")
    now = store_at(ordered, path)
    before = _state(now)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        above, middle, below, fresh = (scratch_path(spark, "stars") for _ in range(4))
        now = store_at(_small_star(store_at(_large_star(now, above), middle), below), fresh)
        for used in (path, above, middle, below):
            discard(spark, used)
        path, after = fresh, _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select("u", F.col("v").alias("root"))
