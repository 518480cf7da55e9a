"""Targets by plain water filling, and how near the mix comes to them."""

import re

import pytest
from pyspark.sql import functions as F

from flightlag.llm import mixing
from tests.compare import connect, difference
from tests.llm import brute


def filled(sizes: dict, weights=(1, 2, 3), most=3.0) -> dict:
    """Shares by weight; what is above a cap is shared again until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = {}, float(sum(sizes.values()))
    while True:
        rest = [s for s in names if s not in capped]
        if not rest:
            return capped
        left, shares = total - sum(capped.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / shares > most * sizes[s]]
        if not over:
            return capped | {s: left * weight[s] / shares for s in rest}
        capped |= {s: most * sizes[s] for s in over}


def words(text) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("folder", ["given", "awkward", "empty"])
def test_query(spark, sf_dir, awkward_dir, empty_dir, folder):
    where = {"given": sf_dir, "awkward": awkward_dir, "empty": empty_dir}[folder]
    assert difference(mixing.op7_mixing(spark, where), connect(where), mixing.OP7_SQL) is None
    docs = brute.table(where, "documents")
    sizes: dict = {}
    source_of, longest = {}, {}
    for d in docs:
        n = words(d["text"])
        sizes[d["source"]] = sizes.get(d["source"], 0) + n
        source_of[d["doc_id"]] = d["source"]
        longest[d["source"]] = max(n, longest.get(d["source"], 0))
    targets = filled(sizes)
    assert not sizes or sum(targets.values()) == pytest.approx(sum(sizes.values()))
    got: dict = {}
    for r in mixing.mix(mixing.mix_rows(spark.read.parquet(f"{where}/documents.parquet"))).collect():
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        got[r["source"]] = got.get(r["source"], 0) + r["taken"]
    for source, taken in got.items():
        assert abs(taken - targets[source]) <= longest[source] / 2 + 1e-6


def test_heavier_documents_come_first(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < 15_000, "big").otherwise("small").alias("source"),
        F.lit(10).alias("size"),
        F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("quality"),
        mixing.uniform(F.col("id")).alias("u"),
    )
    taken = mixing.mix(rows, weights=(1, 1)).where("source = 'big'").groupBy(F.col("doc_id") % 2).agg(F.sum("copies"))
    even, odd = (dict(map(tuple, taken.collect()))[k] for k in (0, 1))
    assert even + odd == 10_000 and even > 1.4 * odd


def test_reruns_agree_and_extra_columns_go(spark, awkward_dir):
    docs = spark.read.parquet(f"{awkward_dir}/documents.parquet")
    first = mixing.mix(mixing.mix_rows(docs)).collect()
    again = mixing.mix(mixing.mix_rows(docs.repartition(5).withColumn("target", F.lit("x")))).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


@pytest.mark.parametrize("quality", [1.0, 0.1, 1e-9])
def test_no_piece_holds_many_rows_of_a_source(spark, monkeypatch, quality):
    frames = {}
    store = mixing.store
    monkeypatch.setattr(mixing, "store", lambda df, label: frames.setdefault(label, store(df, label)))
    rows = spark.range(100_000).select(
        F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(1).cast("long").alias("size"),
        F.lit(quality).alias("quality"), mixing.uniform(F.col("id")).alias("u"),
    )
    assert mixing.mix(rows).count() == 100_000
    # 100,000 / 4,096 is 24.
    assert frames["mix-rows"].groupBy("piece").count().agg(F.max("count")).first()[0] < 75
