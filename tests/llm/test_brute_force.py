"""Queries that SQL does not express, against plain Python; on given and on awkward rows."""

import hashlib
from collections import Counter

import pytest

from flightlag.llm import decontaminate, secret_scan, sharding, simhash, suffix_dedup, token_files
from tests.llm import brute


@pytest.fixture(scope="module", params=["given", "awkward", "empty"])
def folder(request, sf_dir, awkward_dir, empty_dir):
    return {"given": sf_dir, "awkward": awkward_dir, "empty": empty_dir}[request.param]


def test_simhash(spark, folder):
    want = brute.near_groups(brute.table(folder, "documents"))
    assert brute.rows_of(simhash.op2_simhash(spark, folder)) == brute.counted(want)


def test_token_files(spark, folder):
    want = brute.token_rows(brute.table(folder, "documents"), token_files.default_tokenizer())
    assert brute.rows_of(token_files.op4_token_files(spark, folder)) == brute.counted(want)


def test_contamination(spark, folder):
    docs, items = brute.table(folder, "documents"), brute.table(folder, "benchmark")
    found = brute.rows_of(decontaminate.op6_decontaminate(spark, folder))
    assert found == brute.counted(brute.contamination(docs, items))


def test_repeats(spark, folder):
    docs = [d for d in brute.table(folder, "documents") if d["doc_id"] is not None]
    firsts, again = {}, Counter()
    for d in docs:
        again[d["doc_id"]] += 1
        firsts[d["doc_id"]] = d
    want = {r["doc_id"]: r for r in brute.repeats(list(firsts.values()))}
    found = suffix_dedup.op8_suffix_dedup(spark, folder).where("doc_id IS NOT NULL")
    expected = Counter({tuple(sorted(want[i].items())): n for i, n in again.items()})
    assert brute.rows_of(found) == expected


def test_base_secrets(spark, folder):
    found = Counter()
    for r in secret_scan.op9_secret_scan(spark, folder).collect():
        spans = [s for s in r["spans"].split(",") if s and not s.startswith("lexed")]
        found[r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], ",".join(spans)] += 1
    want = Counter()
    for d in brute.table(folder, "documents"):
        spans = brute.base_secrets(d["text"])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        kinds = Counter(k for k, _, _ in spans)
        want[d["doc_id"], kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(text.encode()).hexdigest(), text] += 1
    assert found == want


def test_sharding_law(spark, folder):
    docs = brute.table(folder, "documents")
    rows = sharding.op1_sharding(spark, folder).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d["doc_id"], len((d["text"] or "").encode()) + 16) for d in docs)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(40)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(docs)
