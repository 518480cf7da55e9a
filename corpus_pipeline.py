"""Documents to token files in stages; each stage is one operator at work on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlag.llm.common import free_name, read_table, store
from flightlag.llm.decontaminate import contamination, is_contaminated
from flightlag.llm.language_id import UNDETERMINED, fit_on_two_thirds
from flightlag.llm.mixing import mix, mix_rows
from flightlag.llm.simhash import near_groups
from flightlag.llm.token_files import token_output


#: Words a worker remembers for the token files: it shares its executor with what the stages before left there.
CACHED_WORDS = 150_000


def _as_rows(docs: DataFrame) -> DataFrame:
    """(row, id, hash): all columns of a document as one, so that no name of theirs meets one of a stage."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))


def _matching(docs: DataFrame, decisions: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` by (id, hash) of ``decisions``; null ids meet null ids."""
    d, k = _as_rows(docs).alias("d"), decisions.alias("k")
    return d.join(k, F.col("d.id").eqNullSafe(F.col("k.id")) & (F.col("d.hash") == F.col("k.hash")), how)


def _each_once(docs: DataFrame, decisions: DataFrame, *more: str) -> DataFrame:
    """Rows of ``docs`` with their decision, rows equal in id and text once.

    ``decisions`` has one row per (id, hash), the number ``rows`` of rows that share them,
    and the columns ``more``. Only rows that repeat are dealt out again to be told apart.
    """
    met = _matching(docs, decisions, "inner").select("d.*", "k.rows", *more)
    again = met.where("rows > 1").dropDuplicates(["id", "hash"])
    return met.where("rows = 1").unionByName(again)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are null, empty or without a letter, and all others that get no language, go.

    Rows that repeat are judged alike, whole texts of any length are read, ties between
    languages go to the first by name, an empty table stays empty. Columns of any name stay.
    """
    pred, score = free_name(docs, "lang_told"), free_name(docs, "score_told")
    told = fit_on_two_thirds(docs).predict(docs, pred=pred, score=score)
    return told.where(F.col(pred) != UNDETERMINED).drop(pred, score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest id stays, one without an id before all others.

    Of rows that repeat this id the one with the smallest text hash stays, once. Texts without
    words, null ones too, are a group, with those whose fingerprints are near theirs. An empty
    table stays empty. Columns of any name stay.
    """
    row_id = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    groups = near_groups(docs.select("text", row_id.alias("row_id")), "row_id")
    kept = groups.where(F.col("row_id") == F.col("component_id")).groupBy("row_id").agg(F.count("*").alias("rows"))
    return _each_once(docs, kept.select("row_id.*", "rows")).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in twenty lies in passages of the benchmark go.

    Null and empty texts have no words and stay, and so do all without a benchmark. Rows that
    repeat in id and text are judged alike, rows that share an id each by its own text. An
    empty table stays empty. Columns of any name stay.
    """
    found = contamination(docs, read_table(spark, sf_dir, "benchmark")).where(is_contaminated())
    marked = found.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    return _matching(docs, marked, "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times.

    Rows equal in id and text become one that is taken as often as they are together. Null
    sources are a source, null and empty texts have no words. Ties of the order go to the
    smaller id. An empty table stays empty. Columns of any name stay.
    """
    mixed = mix(mix_rows(docs), carry=("text_hash",))
    taken = (
        mixed.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
        .agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("rows"))
        .where("copies > 0")
    )
    once = _each_once(docs, taken, "copies")
    return once.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, read back: (doc_id, start, n_tokens, ids_crc32).

    Null and empty texts are their end alone. Repeated rows and ids stay, rows without an id
    come first; an empty table gives no rows. Only id and text are read.
    """
    return token_output(spark, docs.select("doc_id", "text"), cached_words=CACHED_WORDS)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_files", token_files),
]

#: SQL cannot express the stages; tests compare them with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
