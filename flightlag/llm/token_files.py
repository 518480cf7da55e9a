"""Token-ID output: tokenised documents as rANS blocks with a shared frequency table."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightlag.llm.common import bound_batches, discard, pieces, read_table, store_at
from flightlag.llm.rans import Block, Table, encode
from flightlag.session import scratch_path

END_ID = 2
BLOCK_TOKENS = 1 << 18
TEXT_AT_ONCE = 1 << 22
#: Words whose ids a task remembers before it starts anew.
CACHED_WORDS = 900_000
#: New words given to the tokenizer as one text.
WORDS_AT_ONCE = 200
#: Signs that are no part of a word they follow.
SIGNS = ".,!?;:%*#$&|)]}"

#: All that is white space to any script, but a line end at the start.
WORD = r"^\n?[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+$"

RAW_SCHEMA = "part int, block int, first_token long, doc_ids array<long>, lengths array<int>, ids binary"
FILE_SCHEMA = "part int, block int, first_token long, n_tokens long, doc_ids array<long>, lengths array<int>, payload binary"


class WordEncoder:
    """Ids of whole texts, by remembering the ids of words.

    A byte-level BPE merges within words only: a text whose words are parted by
    single blanks and line ends has the ids of its words, each with the blank or
    line end before it. Signs that end a word are merged among themselves, so its ids are
    those of the word without them and theirs. Any other text, and one that holds the
    string of a special token, is given to the tokenizer as it is.

    Texts are split and their distinct words numbered by Arrow, so only distinct words
    are looked up one by one.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        self.cached_words = cached_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        splits = self.tokenizer.pre_tokenizer
        self.parts_signs = (
            isinstance(splits, pre_tokenizers.ByteLevel) and splits.use_regex and self.tokenizer.normalizer is None
        )
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2") if len(vocabulary) <= 1 << 16 else np.dtype("<u4")
        # In byte-level BPE the letters G and C with dot above stand for a blank and a line end.
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token[0] in "\u0120\u010a"]] = True
        #: Nothing for what is no word.
        self.known: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, as a few texts: a word begins where a blank or line end does."""
        spaced = [w if w[0] == "\n" else " " + w for w in words]
        groups = ["".join(spaced[i : i + WORDS_AT_ONCE]) for i in range(0, len(spaced), WORDS_AT_ONCE)]
        found = self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, self.kind) for e in found])
        at = (np.append(np.flatnonzero(self.opens[ids]), len(ids)) * self.kind.itemsize).tolist()
        if len(at) != len(words) + 1:  # some word has a sign that is taken for a blank
            self.known.update(zip(words, self._ids(spaced)))
            return
        raw = ids.tobytes()
        self.known.update(zip(words, [raw[a:b] for a, b in zip(at[:-1], at[1:])]))

    def _remember(self, words: list[str]) -> list[bytes]:
        """Ids of ``words``, none for what is no word."""
        if len(self.known) > self.cached_words:
            self.known.clear()
        ids = list(map(self.known.get, words))
        new = [w for w, found in zip(words, ids) if found is None]
        plain = _words_among(new)
        if len(plain) < len(new):
            self.known.update(dict.fromkeys(new, b""))
        if plain:
            self._learn_parts(plain) if self.parts_signs else self._learn(plain)
        return [self.known[w] if found is None else found for w, found in zip(words, ids)] if new else ids

    def _learn_parts(self, words: list[str]) -> None:
        """Words that end in signs from what they are without."""
        column = pa.array(words, pa.string())
        stems = pc.utf8_rtrim(column, SIGNS)
        ended = pc.and_(pc.not_equal(stems, column), pc.match_substring_regex(stems, r"[\p{L}0-9]$"))
        of = stems.filter(ended).to_numpy(zero_copy_only=False).tolist()
        whole = [w for w, e in zip(words, ended.to_pylist()) if not e]
        wanted = set(whole).union(s for s in of if s not in self.known)
        if wanted:
            self._learn(list(wanted))
        ending = column.filter(ended).to_numpy(zero_copy_only=False).tolist()
        signs = [w[len(s) :] for w, s in zip(ending, of)]
        new = [s for s in set(signs) if s not in self.signs]
        self.signs.update(zip(new, self._ids(new)))
        self.known.update((w, self.known[s] + self.signs[e]) for w, s, e in zip(ending, of, signs))

    def _first(self, words: set[str]) -> None:
        """Ids of words that begin a text, with no blank before them."""
        if len(self.first) + len(self.signs) > self.cached_words:
            self.first.clear()
            self.signs.clear()
        new = [w for w in _words_among(list(words.difference(self.first))) if w[0] != "\n"]
        self.first.update(zip(new, self._ids(new)))

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text as bytes; null is the empty text."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        column = column.fill_null("") if column.null_count else column
        whole = np.zeros(len(column), bool)
        for special in self.special:
            whole |= pc.match_substring(column, special).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        at = parts.offsets.to_numpy().astype(np.int64)
        numbered = parts.flatten().dictionary_encode()
        code = numbered.indices.to_numpy()
        at -= at[0]
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = self._remember(words)

        # The first word of a text has no blank before it and is looked up by itself.
        opening = at[:-1]
        placed = code.copy()
        placed[opening] = len(words)
        unknown = np.array([not x for x in ids] + [False], bool)
        laid = pa.array(ids + [b""], pa.large_binary()).take(pa.array(placed))
        raw = laid.buffers()[2]
        ends = np.frombuffer(laid.buffers()[1], np.int64)[laid.offset : laid.offset + len(laid) + 1]
        broken = np.concatenate([[0], np.cumsum(unknown[placed])])
        whole |= broken[at[1:]] > broken[at[:-1]]
        firsts = [words[c] for c in code[opening].tolist()]
        self._first(set(firsts))
        out, single = [], np.diff(at) == 1
        for i, (start, end) in enumerate(zip(ends[at[:-1]].tolist(), ends[at[1:]].tolist())):
            first = b"" if single[i] and not firsts[i] else self.first.get(firsts[i])
            whole[i] |= first is None
            out.append(b"" if whole[i] else first + raw[start:end].to_pybytes())
        aside = np.flatnonzero(whole).tolist()
        for i, found in zip(aside, self._ids([column[i].as_py() for i in aside])):
            out[i] = found
        return out


def _words_among(parts: list[str]) -> list[str]:
    """Parts that have signs other than blanks, and no blank but a line end at their start."""
    column = pa.array(parts, pa.string())
    return column.filter(pc.match_substring_regex(column, WORD)).to_numpy(zero_copy_only=False).tolist()


@lru_cache(maxsize=1)
def _encoder(path: str, cached_words: int = CACHED_WORDS) -> WordEncoder:
    return WordEncoder(path, cached_words)


def _tokenise(path: str, end_id: int, cached_words: int) -> Callable:
    """Rows (doc_id, text) in order to raw blocks of whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path, cached_words)
        end = np.array([end_id], coder.kind).tobytes()
        part = TaskContext.get().partitionId()
        doc_ids, ids, held, block, first = [], [], 0, 0, 0
        width = coder.kind.itemsize

        def flush():
            nonlocal doc_ids, ids, held, block, first
            lengths = [len(x) // width for x in ids]
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([doc_ids], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int32())),
                    pa.array([b"".join(ids)], pa.binary()),
                ],
                names=["part", "block", "first_token", "doc_ids", "lengths", "ids"],
            )
            first, block = first + sum(lengths), block + 1
            doc_ids, ids, held = [], [], 0
            return row

        for batch in pieces(batches, "text", TEXT_AT_ONCE):
            for doc_id, coded in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text"))):
                coded += end
                if held and held + len(coded) > BLOCK_TOKENS * width:
                    yield flush()
                doc_ids.append(doc_id)
                ids.append(coded)
                held += len(coded)
        if held:
            yield flush()

    return run


def _raw_ids(value: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(value, kind)


def _count(kind: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for value in batch.column("ids"):
                seen = np.bincount(_raw_ids(value.as_buffer(), kind))
                if len(seen) > len(total):
                    seen[: len(total)] += total
                    total = seen
                else:
                    total[: len(seen)] += seen
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    return run


def _encode(table: Table, kind: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = _raw_ids(row.column("ids")[0].as_buffer(), kind)
                payload = pa.array([encode(ids, table)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [row.column("part"), row.column("block"), row.column("first_token"), pa.array([len(ids)], pa.int64()),
                     row.column("doc_ids"), row.column("lengths"), payload],
                    names=["part", "block", "first_token", "n_tokens", "doc_ids", "lengths", "payload"],
                )

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text: str = "text",
    cached_words: int = CACHED_WORDS,
) -> None:
    """Write the ids of all documents below ``path`` in ascending order of ``id_col``.

    ``path/blocks`` has rows (part, block): ids of whole documents, about
    BLOCK_TOKENS each, coded by ``rans``; a longer document is a block of its own.
    ``path/table`` has the counts of all ids, the table that every block is coded with.
    Null and empty texts have the end id only; null ids come first; rows with equal
    ids are ordered by the hash of their text; other columns are left out. An empty
    table gives files without blocks.

    Texts are dealt out once, by ranges of the id. Counts come from all raw blocks,
    one number per id of the vocabulary. The raw blocks are removed afterwards.
    ``cached_words`` is about how many words each worker remembers, over tasks: the ids
    do not depend on it, time and memory do.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc(), F.xxhash64("text").asc()]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    raw_path = scratch_path(spark, "raw-blocks")
    raw = store_at(ranged.mapInArrow(_tokenise(tokenizer, end_id, cached_words), RAW_SCHEMA), raw_path)
    kind = _encoder(tokenizer).kind.str
    counts = raw.select("ids").mapInArrow(_count(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    stored = store_at(counts, f"{path}/table")
    coded = raw.mapInArrow(_encode(_read_table(stored), kind), FILE_SCHEMA)
    # The payload is packed already.
    coded.write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")
    discard(spark, raw_path)


def _read_table(counts: DataFrame) -> Table:
    """One row per id that occurs: bounded by the vocabulary."""
    rows = counts.orderBy("id").toPandas()
    return Table.from_counts(rows["id"].to_numpy(), rows["n"].to_numpy())


def _decode(table: Table) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = Block(batch.column("payload")[i].as_py(), table).decode().astype("<u4")
                doc_ids = batch.column("doc_ids")[i].values
                lengths = batch.column("lengths")[i].values.to_numpy()
                at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                first = batch.column("first_token")[i].as_py()
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, batch.column("part")[i].as_py()), pa.int32()),
                        doc_ids,
                        pa.array(first + at[:-1], pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["part", "doc_id", "in_part", "n_tokens", "ids_crc32"],
                )

    return run


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of token files with their ids decoded: (part, block, doc_ids, lengths, ids)."""
    table = _read_table(spark.read.parquet(f"{path}/table"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [Block(p.as_py(), table).decode().tolist() for p in batch.column("payload")]
            columns = [batch.column(c) for c in ("part", "block", "doc_ids", "lengths")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(ids, pa.list_(pa.int64()))], names=["part", "block", "doc_ids", "lengths", "ids"]
            )

    schema = "part int, block int, doc_ids array<long>, lengths array<int>, ids array<long>"
    return spark.read.schema(FILE_SCHEMA).parquet(f"{path}/blocks").mapInArrow(run, schema)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from its files.

    ``start`` counts the ids of all documents before. Blocks are decoded wherever
    they are; the ids of earlier parts are added from one row per part.
    """
    bound_batches(spark)
    blocks = spark.read.schema(FILE_SCHEMA).parquet(f"{path}/blocks")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        blocks.groupBy("part")
        .agg(F.sum("n_tokens").alias("n"))
        .select(F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    table = _read_table(spark.read.parquet(f"{path}/table"))
    schema = "part int, doc_id long, in_part long, n_tokens long, ids_crc32 long"
    decoded = blocks.drop("block", "n_tokens").mapInArrow(_decode(table), schema)
    # One row per write task, whatever the number of documents.
    met = decoded.join(F.broadcast(parts), F.col("part") == F.col("of_part"))
    return met.select("doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_output(
    spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, cached_words: int = CACHED_WORDS
) -> DataFrame:
    """Write token files of ``docs`` to a fresh folder and read them back."""
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer or default_tokenizer(), cached_words=cached_words)
    return read_token_files(spark, path)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"))
