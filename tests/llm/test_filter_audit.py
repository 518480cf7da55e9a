"""Posting lists, their unions and the audit of five filters."""

from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flightlag.llm import filter_audit as audit
from tests.compare import connect, difference
from tests.llm import brute

sorted_ids = st.sets(st.integers(0, 60)).map(lambda s: np.array(sorted(s), np.int32))


@given(sorted_ids, sorted_ids)
def test_held_by_is_membership(a, b):
    assert audit.held_by(a, b).tolist() == [x in set(b.tolist()) for x in a.tolist()]


@settings(max_examples=60)
@given(st.lists(sorted_ids, min_size=1, max_size=5))
def test_union_of_sorted_lists(lists):
    assert audit.union(lists).tolist() == sorted({x for a in lists for x in a.tolist()})


@pytest.fixture(params=["given", "awkward", "empty"])
def folder(request, sf_dir, awkward_dir, empty_dir):
    return {"given": sf_dir, "awkward": awkward_dir, "empty": empty_dir}[request.param]


def test_rows_of_its_sql(spark, folder):
    assert difference(audit.op11_filter_audit(spark, folder), connect(folder), audit.OP11_SQL) is None


def test_shape_of_the_result(spark, sf_dir):
    rows = audit.op11_filter_audit(spark, sf_dir).collect()
    parts = {d["lang"] or "" for d in brute.table(sf_dir, "documents")}
    orders = {"".join(p) for p in permutations("ABCDE")}
    assert {(r["part"], r["filter_order"], r["step"]) for r in rows} == {(p, o, k) for p in parts for o in orders for k in range(1, 6)}
    assert len(rows) == len(parts) * 600


def test_ranges_hold_every_row_once(spark, awkward_dir):
    docs = spark.read.parquet(f"{awkward_dir}/documents.parquet")
    rows = docs.select(
        F.coalesce("lang", F.lit("")).alias("part"),
        F.col("doc_id").alias("id"),
        F.monotonically_increasing_id().alias("row"),
        (F.length("text") > 50).alias("long"),
    )
    found = audit.posting_lists(rows, ["long"], range_rows=7).collect()
    assert all(len(r["ids"]) <= 7 and r["long"] == sorted(set(r["long"])) for r in found)
    per_part = {}
    for r in found:
        have = per_part.setdefault(r["part"], [0, 0])
        have[0] += len(r["ids"])
        have[1] += len(r["long"])
    want = {r["part"]: [r["n"], r["k"]] for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.count_if("long").alias("k")).collect()}
    assert per_part == want


def test_other_columns_may_have_any_name(spark, awkward_dir):
    docs = spark.read.parquet(f"{awkward_dir}/documents.parquet")
    labels = spark.read.parquet(f"{awkward_dir}/labels.parquet")
    names = ["id", "part", "digest", "row", "key", "lost", "hot", "first_id", "A", "E", "good", "toxic_", "_of", "mask"]
    wide = docs.withColumns({n: F.lit("x") for n in names})
    wide_labels = labels.withColumns({n: F.lit("x") for n in ["key", "lost", "good", "id"]})
    assert brute.rows_of(audit.filter_audit(wide, wide_labels)) == brute.rows_of(audit.filter_audit(docs, labels))


def test_a_text_of_a_third_of_all_rows(spark):
    """Copies of one text count like any others and meet no exchange under one key."""
    docs = spark.range(6_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"),
        F.lit("en").alias("lang"),
    )
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {(r["filter_order"], r["step"]): r for r in audit.filter_audit(docs, labels).collect()}
    first = rows["EABCD", 1]
    assert (first["removed"], first["kept"], first["good_lost"]) == (1_999, 4_001, 1)
