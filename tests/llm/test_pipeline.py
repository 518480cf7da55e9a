"""The pipeline against plain Python, stage by stage on what the stage before kept."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from flightlag.llm.common import store
from flightlag.llm.language_id import fit_on_two_thirds
from flightlag.llm.mixing import mix, mix_rows
from flightlag.llm.token_files import default_tokenizer
from tests.llm import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def key(row: dict) -> tuple:
    return row["doc_id"], row["text"]


def test_registered():
    assert entry_module.queries()["pipeline"] is corpus_pipeline.run
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "simhash_dedup", "decontaminate", "mix_sources", "token_files",
    ]


@pytest.mark.parametrize("folder", ["given", "awkward"])
def test_stages(spark, sf_dir, awkward_dir, folder):
    where = {"given": sf_dir, "awkward": awkward_dir}[folder]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    before = rows_of(docs)

    model = fit_on_two_thirds(docs)
    docs = store(stages["language_id"](spark, docs, where), "t1")
    kept = rows_of(docs)
    assert docs.columns == COLUMNS and model.statistics.languages
    assert Counter(map(key, kept)) == Counter(key(r) for r in before if any(c.isalpha() for c in r["text"] or ""))

    docs = store(stages["simhash_dedup"](spark, docs, where), "t2")
    before, kept = kept, rows_of(docs)
    groups: dict = {}
    of = brute.components([brute.simhash(r["text"]) for r in before], lambda a, b: bin(a ^ b).count("1") <= 2)
    for r in before:
        groups.setdefault(of[brute.simhash(r["text"])], []).append(r)
    assert docs.columns == COLUMNS and len(kept) == len(groups)
    chosen = {of[brute.simhash(r["text"])]: r for r in kept}
    for g, members in groups.items():
        first = min(members, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        assert chosen[g]["doc_id"] == first["doc_id"] and key(chosen[g]) in set(map(key, members))

    docs = store(stages["decontaminate"](spark, docs, where), "t3")
    before, kept = kept, rows_of(docs)
    marks = brute.contamination(before, brute.table(where, "benchmark"))
    assert docs.columns == COLUMNS
    assert Counter(map(key, kept)) == Counter(key(r) for r, m in zip(before, marks) if not m["contaminated"])

    mixed = {(r["doc_id"], r["text_hash"]): r["copies"] for r in mix(mix_rows(docs), carry=("text_hash",)).collect()}
    docs = store(stages["mix_sources"](spark, docs, where), "t4")
    before, kept = kept, rows_of(docs)
    assert docs.columns == COLUMNS and len(kept) == sum(mixed.values())
    assert set(map(key, kept)) <= set(map(key, before)) and max(Counter(map(key, kept)).values()) <= 3

    last = stages["token_files"](spark, docs, where)
    assert brute.rows_of(last) == brute.counted(brute.token_rows(kept, default_tokenizer()))


def test_empty_tables_and_whole_run(spark, sf_dir, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and whole.count() > 50


CLASHING = ["id", "hash", "rows", "row", "copies", "told", "lang_told", "score_told", "d", "k", "row_id", "text_hash", "a.b"]


@pytest.mark.parametrize("stage", ["language_id", "simhash_dedup", "decontaminate", "mix_sources", "token_files"])
def test_columns_of_any_name_stay(spark, awkward_dir, stage):
    docs = spark.read.parquet(f"{awkward_dir}/documents.parquet")
    more = docs.select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASHING])
    step = dict(corpus_pipeline.STAGES)[stage]
    plain, kept = rows_of(step(spark, docs, awkward_dir)), step(spark, more, awkward_dir)
    if stage != "token_files":
        assert kept.columns == more.columns
        assert all(r[c] == f"mine {c}" for r in rows_of(kept) for c in CLASHING)
        assert Counter(map(key, rows_of(kept))) == Counter(map(key, plain))
    else:
        assert Counter(map(str, rows_of(kept))) == Counter(map(str, plain))


def test_repeated_rows_stay_once(spark, awkward_dir):
    docs = spark.read.parquet(f"{awkward_dir}/documents.parquet")
    taken = corpus_pipeline.mix_sources(spark, docs.unionByName(docs), awkward_dir)
    assert 0 < taken.count()
    kept = rows_of(corpus_pipeline.near_dedup(spark, docs.unionByName(docs), awkward_dir))
    assert max(Counter(map(key, kept)).values()) == 1
