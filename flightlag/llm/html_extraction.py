"""Main text of pages: boosted trees judge every block, one choice per tree of blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlag.llm.common import bound_batches, discard, free_name, pieces, read_table, store_at
from flightlag.llm.dom import FEATURES, ROLES, Blocks, Page, blocks_of, parse
from flightlag.llm.layouts import MARK, layout, marked_labels, parts_of, silver_labels
from flightlag.session import scratch_path

#: The trees are fitted on about so many pages that tell their article, chosen by hash.
FIT_PAGES = 400
#: Layouts drawn from each of them, besides the page as it is.
LAYOUTS = 3
TREES = 16
DEPTH = 5
STEP = 0.4
HTML_AT_ONCE = 1 << 20

# What a block can be: no main text in it, none of its own but in blocks below, main text.
DROP, AROUND, MAIN = 0, 1, 2


# -------------------------------------------------------------------- model


@dataclass(frozen=True)
class Forest:
    """Boosted regression trees as arrays; a row per tree, leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, spark: SparkSession, model: GBTClassificationModel) -> Forest:
        """From the saved model; its trees have fewer than 2^(depth + 1) nodes each."""
        path = scratch_path(spark, "trees")
        model.write().overwrite().save(path)
        node = F.col("nodeData")
        rows = spark.read.parquet(f"{path}/data").select(
            "treeID", node["id"], node["split"]["featureIndex"], F.get(node["split"]["leftCategoriesOrThreshold"], 0),
            node["leftChild"], node["rightChild"], node["prediction"],
        )
        nodes = [tuple(r) for r in rows.collect()]
        discard(spark, path)
        shape = (len(model.treeWeights), 1 + max(n[1] for n in nodes))
        feature, threshold, value = np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape)
        left, right = (np.tile(np.arange(shape[1]), (shape[0], 1)) for _ in range(2))
        for tree, at, of, limit, below, above, told in nodes:
            value[tree, at] = told
            if below >= 0:
                feature[tree, at], threshold[tree, at], left[tree, at], right[tree, at] = of, limit, below, above
        return cls(feature, threshold, left, right, value, np.array(model.treeWeights))

    def probability(self, features: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(features))
        rows = np.arange(len(features))
        for t, weight in enumerate(self.weight):
            at = np.zeros(len(features), np.int64)
            for _ in range(DEPTH):
                below = features[rows, self.feature[t, at]] <= self.threshold[t, at]
                at = np.where(below, self.left[t, at], self.right[t, at])
            margin += weight * self.value[t, at]
        return 1 / (1 + np.exp(-2 * margin))


@dataclass(frozen=True)
class Judge:
    """How likely a block is main text, and how likely it or a block below it is."""

    main: Forest
    holds: Forest

    def scores(self, blocks: Blocks) -> np.ndarray:
        """Log likelihood of DROP, AROUND and MAIN for every block."""
        main = np.clip(self.main.probability(blocks.features), 1e-6, 1 - 1e-6)
        holds = np.clip(self.holds.probability(blocks.features), 1e-6, 1 - 1e-6)
        return np.log(np.column_stack([1 - holds, np.maximum(holds - main, 1e-6), main]))


class RoleJudge:
    """Without a page to learn from: main text is what has no role but that of content."""

    def scores(self, blocks: Blocks) -> np.ndarray:
        roles = [FEATURES.index(f"is_{r}") for r in ROLES if r not in ("content", "header")]
        other = blocks.features[:, roles].any(1)
        return np.where(other[:, None], np.log([0.98, 0.01, 0.01]), np.log([0.01, 0.01, 0.98]))


def decode(blocks: Blocks, scores: np.ndarray) -> np.ndarray:
    """The likeliest choice of all blocks together in which no block contradicts the one around it.

    Below a dropped block all is dropped; below main text a block is main text or dropped;
    the rest is free. Sums are taken from the leaves up, choices from the root down.
    """
    best = scores.copy()
    parent, depth = blocks.parent, blocks.depth
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 1)))
    for level in levels[:0:-1]:
        b = best[level]
        in_main = np.maximum(b[:, DROP], b[:, MAIN])
        np.add.at(best, parent[level], np.column_stack([b[:, DROP], np.maximum(in_main, b[:, AROUND]), in_main]))
    choice = best.argmax(1)
    allowed = np.array([[True, False, False], [True, True, True], [True, False, True]])
    for level in levels[1:]:
        free = np.where(allowed[choice[parent[level]]], best[level], -np.inf)
        choice[level] = free.argmax(1)
    return choice


def main_texts(pages: list[Page], judge: Judge | RoleJudge) -> list[str]:
    """Runs of main text of each page, one a line."""
    blocks = blocks_of(pages)
    choice = decode(blocks, judge.scores(blocks))
    out = []
    for page, first in zip(pages, blocks.first):
        out.append("\n".join(text for block, text in page.runs if choice[first + block] == MAIN))
    return out


# ---------------------------------------------------------------------- fit


def _examples(batches: Iterator[pa.RecordBatch], layouts: int) -> Iterator[pa.RecordBatch]:
    """Pages to labelled blocks: (features, main, holds)."""
    for batch in pieces(batches, "html", HTML_AT_ONCE):
        pages, labels = [], []
        for html, seed in zip(batch.column("html").to_pylist(), batch.column("seed").to_pylist()):
            page = parse(html)
            told = silver_labels(page)
            if told is None:
                continue
            pages.append(page)
            labels.append(told)
            parts = parts_of(page, told)
            for k in range(layouts if parts else 0):
                pages.append(parse(layout(parts, seed * layouts + k), MARK))
                labels.append(marked_labels(pages[-1]))
        if not pages:
            continue
        blocks = blocks_of(pages)
        main = np.concatenate(labels)
        holds = main.copy()
        for i in np.argsort(-blocks.depth, kind="stable"):
            if holds[i] and blocks.parent[i] >= 0:
                holds[blocks.parent[i]] = True
        ends = pa.array(np.arange(len(main) + 1, dtype=np.int32) * blocks.features.shape[1])
        features = pa.ListArray.from_arrays(ends, pa.array(blocks.features.ravel().astype(np.float64)))
        yield pa.RecordBatch.from_arrays(
            [features, pa.array(main.astype(np.float64)), pa.array(holds.astype(np.float64))], names=["features", "main", "holds"]
        )


def fit(
    pages: DataFrame, html: str = "html", fit_pages: int = FIT_PAGES, layouts: int = LAYOUTS, trees: int = TREES
) -> Judge | RoleJudge:
    """Boosted trees from about ``fit_pages`` pages, chosen by the hash of their text.

    Labels come from pages that mark their article, as they are and set in ``layouts`` other
    layouts. If no chosen page does, roles decide. Everything else (features,
    decoding) reads every block of every page.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    told = pages.select(F.col(html).alias("html"), F.xxhash64(html).alias("seed")).where(F.col("html").isNotNull())
    steps = 1 << 30
    share = -(-fit_pages * steps // max(told.count(), 1))
    chosen = told.where(F.pmod(F.col("seed"), F.lit(steps)) < share)
    path = scratch_path(spark, "blocks")
    examples = chosen.mapInArrow(lambda b: _examples(b, layouts), "features array<double>, main double, holds double")
    blocks = store_at(examples.repartition(4), path)
    kinds = blocks.agg(F.count("*"), F.min("main"), F.max("main"), F.min("holds"), F.max("holds")).first()  # one row
    if not kinds[0] or kinds[1] == kinds[2] or kinds[3] == kinds[4]:
        discard(spark, path)
        return RoleJudge()
    rows = blocks.select(array_to_vector("features").alias("features"), "main", "holds")
    booster = GBTClassifier(maxIter=trees, maxDepth=DEPTH, stepSize=STEP, maxBins=64, seed=7, featuresCol="features")
    made = Judge(*(Forest.of(spark, booster.setLabelCol(label).fit(rows)) for label in ("main", "holds")))
    discard(spark, path)
    return made


def extract(pages: DataFrame, judge: Judge | RoleJudge, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` in a column ``text``, which gives way if there.

    Pages are judged in the rows they are in, whole and without a shuffle. A null or empty
    page, and one without main text, gives the empty text; rows that repeat are alike;
    an empty table stays empty. A page of any length is one tree in one task.
    """
    bound_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(judge)  # trees of fixed depth and number

    @F.arrow_udf("string")
    def main_text(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out: list[str] = []
            batch = pa.RecordBatch.from_arrays([column], names=["html"])
            for part in pieces(iter([batch]), "html", HTML_AT_ONCE):
                out += main_texts([parse(h) for h in part.column("html").to_pylist()], held.value)
            yield pa.array(out, pa.string())

    kept = [c for c in pages.columns if c.lower() != text.lower()]
    found = free_name(pages, "found")
    told = pages.withColumn(found, main_text(F.col(html)))
    return told.select(*kept, F.col(found).alias(text))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = extract(pages, fit(pages)).drop("html")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
