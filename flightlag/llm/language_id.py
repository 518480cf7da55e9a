"""Language ID by prediction by partial matching over bytes."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlag.llm.common import bound_batches, discard, flat_text, free_name, lower_ascii, pieces, read_table, store_at
from flightlag.session import scratch_path

#: Bytes of context at most.
ORDER = 3
UNDETERMINED = "und"
#: The model is fitted on at most about so many documents per language, chosen by hash.
FIT_DOCUMENTS = 10_000
#: Grams of the languages that are scored together; a language with more is a group of its own.
GROUP_GRAMS = 2_000_000
TEXT_AT_ONCE = 1 << 20
#: Bytes of text a task reads before it turns to the next group.
TEXT_FOR_GROUPS = 1 << 25


def in_thirds(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null where the id is."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _contexts(symbols: np.ndarray, at: np.ndarray, pad: int) -> list[np.ndarray]:
    """The three symbols before each position, nearest first; ``pad`` before a text begins."""
    out, n = [], len(symbols)
    for back in range(1, ORDER + 1):
        before = np.empty(n, symbols.dtype)
        before[:back], before[back:] = pad, symbols[: max(0, n - back)]
        for k in range(back):
            start = at[:-1] + k
            before[start[start < n]] = pad
        out.append(before)
    return out


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang number, text) to counts of 4-grams: (lang, gram, n). The pad is byte 0."""
    keys, counts, held = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(inverse, np.concatenate(counts), len(key)).astype(np.int64)

    def rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        lang = pa.array((key >> np.uint64(32)).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [lang, pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"]
        )

    for batch in pieces(batches, "text", TEXT_AT_ONCE):
        raw, at = flat_text(batch.column("text"))
        lang = batch.column("lang").to_numpy(zero_copy_only=False).astype(np.uint64)
        symbols = lower_ascii(raw)
        code = symbols.astype(np.uint64)
        for back, before in enumerate(_contexts(symbols, at, 0), 1):
            code |= before.astype(np.uint64) << np.uint64(8 * back)
        code |= np.repeat(lang, np.diff(at)) << np.uint64(32)
        key, n = np.unique(code, return_counts=True)
        keys.append(key)
        counts.append(n)
        held += len(key)
        if held > 4_000_000:
            key, n = merged()
            keys, counts, held = [key], [n], len(key)
            if held > 2_000_000:  # many languages: the counts are added up later
                yield rows(key, n)
                keys, counts, held = [], [], 0
    if keys:
        yield rows(*merged())


@dataclass(frozen=True)
class Statistics:
    """Frozen counts: gram (three bytes of context and a byte), language number, count."""

    languages: tuple[str, ...]
    lang: np.ndarray
    gram: np.ndarray
    n: np.ndarray


class CodeLengths:
    """For each language the bits every byte costs in every context, from ``Statistics``.

    A byte seen n times in a context of N bytes, d of them distinct, costs
    -log2(n / (N + d)). One not seen costs the escape, -log2(d / (N + d)), and then
    what it costs in the context one byte shorter; below the empty context all 256
    bytes are alike. Contexts a language lacks cost it no escape.

    A language's tree is sorted arrays of what it has seen, so it takes room by its
    own grams. Distinct grams of a batch of texts are looked up once per language.
    """

    def __init__(self, statistics: Statistics):
        self.n_languages = len(statistics.languages)
        self.trees = []
        order = np.argsort(statistics.lang, kind="stable")
        ends = np.searchsorted(statistics.lang[order], np.arange(self.n_languages + 1))
        for start, end in zip(ends[:-1], ends[1:]):
            mine = order[start:end]
            self.trees.append(self._tree(statistics.gram[mine].astype(np.uint32), statistics.n[mine].astype(np.float64)))

    @staticmethod
    def _tree(gram: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """From the empty context on: contexts, their escapes, grams, their costs; both sorted."""
        levels = []
        for length in range(ORDER + 1):
            seen, inverse = np.unique(gram & np.uint32((1 << 8 * (length + 1)) - 1), return_inverse=True)
            count = np.bincount(inverse, n, len(seen))
            context, of = np.unique(seen >> np.uint32(8), return_inverse=True)
            total = np.bincount(of, count, len(context))
            distinct = np.bincount(of, minlength=len(context)).astype(np.float64)
            escape = np.log2(total + distinct) - np.log2(distinct)
            levels.append((context, escape, seen, np.log2((total + distinct)[of]) - np.log2(count)))
        return levels

    @staticmethod
    def _cost(tree: list[tuple[np.ndarray, ...]], gram: np.ndarray) -> np.ndarray:
        cost = np.full(len(gram), 8.0)
        for length, (context, escape, seen, bits) in enumerate(tree):
            if not len(seen):
                continue
            key = gram & np.uint32((1 << 8 * (length + 1)) - 1)
            at = np.minimum(np.searchsorted(context, key >> np.uint32(8)), len(context) - 1)
            cost += np.where(context[at] == key >> np.uint32(8), escape[at], 0.0)
            at = np.minimum(np.searchsorted(seen, key), len(seen) - 1)
            cost = np.where(seen[at] == key, bits[at], cost)
        return cost.astype(np.float32)

    def bits(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length of each text (bytes end to end) in each language."""
        out = np.zeros((len(at) - 1, self.n_languages))
        if len(raw) == 0:
            return out
        symbols = lower_ascii(raw)
        code = symbols.astype(np.uint32)
        for back, before in enumerate(_contexts(symbols, at, 0), 1):
            code |= before.astype(np.uint32) << np.uint32(8 * back)
        place, gram = pd.factorize(code)
        order = np.argsort(gram)
        filled = np.flatnonzero(np.diff(at))
        cost = np.empty(len(gram), np.float32)
        for k, tree in enumerate(self.trees):
            cost[order] = self._cost(tree, gram[order])
            out[filled, k] = np.add.reduceat(cost[place], at[:-1][filled], dtype=np.float64)
        return out


def has_letter(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    low = lower_ascii(raw)
    ascii_letters = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    found = ascii_letters[at[1:]] > ascii_letters[at[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(map(str.isalpha, raw[at[i] : at[i + 1]].tobytes().decode("utf-8", "ignore")))
    return found


class LanguageModel:
    """One context tree per language, fitted on labelled documents.

    ``groups`` hold the statistics of some languages each, in the order of their names,
    and are read one at a time: neither the driver nor a task holds two.
    """

    def __init__(self, groups: list[Broadcast]):
        self.groups = groups

    @property
    def statistics(self) -> Statistics:
        """Those of all groups as one, on the driver."""
        empty = np.zeros(0, np.int64)
        all_of, names = [(empty, empty, empty)], []
        for s in map(_read, self.groups):
            all_of.append((s.lang + len(names), s.gram, s.n))
            names += s.languages
        return Statistics(tuple(names), *(np.concatenate(x) for x in zip(*all_of)))

    @classmethod
    def fit(cls, docs: DataFrame, fit_documents: int = FIT_DOCUMENTS, group_grams: int = GROUP_GRAMS) -> LanguageModel:
        """``docs`` has doc_id, text and lang; rows without text or lang teach nothing.

        A language with more than ``fit_documents`` rows gives about so many, chosen
        by the hash of id and text, the same in every run. All languages and all their
        grams are kept; they are cut into groups of about ``group_grams`` grams.
        """
        spark = docs.sparkSession
        bound_batches(spark)
        taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        found = sorted((r["lang"], r["count"]) for r in taught.groupBy("lang").count().collect())  # one row per language
        if not found:
            return cls([])
        steps = 1 << 30
        draw = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(steps))
        # As text: rows handed over from Python would start workers of another kind.
        rows = [
            {"_name": name, "_number": i, "_share": min(steps, -(-fit_documents * steps // n))}
            for i, (name, n) in enumerate(found)
        ]
        kind = "array<struct<_name:string,_number:int,_share:long>>"
        shares = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))
        # One row per language.
        chosen = taught.join(F.broadcast(shares), F.col("lang") == F.col("_name")).where(draw < F.col("_share"))
        counted = (
            chosen.select(F.col("_number").alias("lang"), "text")
            .mapInArrow(_gram_counts, "lang int, gram long, n long")
            .groupBy("lang", "gram")
            .agg(F.sum("n").alias("n"))
        )
        path = scratch_path(spark, "grams")
        grams = store_at(counted, path)
        sizes = {r["lang"]: r["count"] for r in grams.groupBy("lang").count().collect()}  # one row per language
        ends, held = [0], 0
        for i in range(len(found)):
            if i > ends[-1] and held + sizes.get(i, 0) > group_grams:
                ends.append(i)
                held = 0
            held += sizes.get(i, 0)
        groups = []
        for start, end in zip(ends, [*ends[1:], len(found)]):
            kept = grams.where((F.col("lang") >= start) & (F.col("lang") < end)).toPandas()  # bounded by group_grams
            names = tuple(name for name, _ in found[start:end])
            arrays = (kept["lang"].to_numpy() - start, kept["gram"].to_numpy(), kept["n"].to_numpy())
            groups.append(spark.sparkContext.broadcast(Statistics(names, *arrays)))
        discard(spark, path)
        return cls(groups)

    def predict(self, docs: DataFrame, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
        """``docs`` with the predicted language and its probability; columns so named give way.

        The probability is that of the shortest code among all languages alike
        likely. Ties go to the first language by name. Texts that are null or have
        no letter, and all texts if nothing was learned, are ``und`` with score 0.
        Whole texts are scored, in the rows they are in, without a shuffle. If there
        is more than one group, a task scores TEXT_FOR_GROUPS of text by each in turn.
        """
        bound_batches(docs.sparkSession)
        groups = self.groups

        @F.arrow_udf("struct<pred:string,score:double>")
        def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batches, told in _scored(texts, groups):
                start = 0
                for batch in batches:
                    end = start + len(batch)
                    yield pa.StructArray.from_arrays(
                        [pa.array(told[0][start:end], pa.string()), pa.array(told[1][start:end], pa.float64())],
                        names=["pred", "score"],
                    )
                    start = end

        told = free_name(docs, "told")
        return docs.withColumn(told, judge(F.col(text))).select(
            *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in (pred.lower(), score.lower())],
            F.col(f"{told}.pred").alias(pred),
            F.col(f"{told}.score").alias(score),
        )


def _read(group: Broadcast) -> Statistics:
    """From its file where there is one, as ``value`` would keep it."""
    return group.load_from_path(group._path) if getattr(group, "_path", None) else group.value


def _scored(
    texts: Iterator[pa.Array], groups: list[Broadcast]
) -> Iterator[tuple[list[pa.Array], tuple[np.ndarray, np.ndarray]]]:
    """Batches of texts with the predicted languages and scores of all their rows.

    A group is unfolded per task, and gone with it: later stages need the worker's memory.
    """
    only = _read(groups[0]) if len(groups) == 1 else None
    lengths = CodeLengths(only) if only else None
    for batches in _together(texts, TEXT_FOR_GROUPS if len(groups) > 1 else 0):
        n = sum(map(len, batches))
        known, pred = np.zeros(n, bool), np.full(n, UNDETERMINED, object)
        least, total = np.full(n, np.inf), np.zeros(n)
        for k, group in enumerate(groups):
            statistics = only or _read(group)
            unfolded = lengths or CodeLengths(statistics)
            names = np.array(statistics.languages, object)
            row = 0
            for part in pieces((pa.RecordBatch.from_arrays([b], names=["text"]) for b in batches), "text", TEXT_AT_ONCE):
                raw, at = flat_text(part.column("text"))
                here = slice(row, row + part.num_rows)
                row += part.num_rows
                if k == 0:
                    known[here] = has_letter(raw, at)
                bits = unfolded.bits(raw, at)
                old, best = least[here], bits.min(1)
                both = np.minimum(old, best)
                alike = np.exp2(np.maximum(both[:, None] - bits, -1000)).sum(1)
                total[here] = total[here] * np.exp2(np.maximum(both - old, -1000)) + alike
                pred[here] = np.where(best < old, names[bits.argmin(1)], pred[here])
                least[here] = both
            del statistics, unfolded
        known &= len(groups) > 0
        score = np.zeros(n)
        score[known] = 1 / total[known]
        yield batches, (np.where(known, pred, UNDETERMINED), score)


def _together(texts: Iterator[pa.Array], size: int) -> Iterator[list[pa.Array]]:
    """Batches until they have ``size`` bytes."""
    batches, held = [], 0
    for batch in texts:
        batches.append(batch)
        held += batch.nbytes
        if held >= size:
            yield batches
            batches, held = [], 0
    if batches:
        yield batches


def fit_on_two_thirds(docs: DataFrame) -> LanguageModel:
    """Learns from the documents that are not held out: crc32(doc_id) mod 3 is not 1."""
    return LanguageModel.fit(docs.where(in_thirds(F.col("doc_id")) != 1))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = fit_on_two_thirds(docs).predict(docs.select("doc_id", "text"))
    held_out = F.coalesce(in_thirds(F.col("doc_id")) == 1, F.lit(False))
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
