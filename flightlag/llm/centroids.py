"""Centroid clustering: distances to pivots bound the distance to every centroid."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlag.llm.common import discard, read_table, store, store_at
from flightlag.session import scratch_path

COMPONENTS = 64
CLUSTERS = 40
ROUNDS = 5
PIVOTS = 12
#: Squared distances of components up to this size fit a long.
LARGEST = 1 << 27
#: Rows whose bounds and exact distances are held at once.
ROWS_AT_ONCE = 1_000
#: What the bounds may be off, as a share of the squared distances they come from.
SLACK = 1e-5


@dataclass(frozen=True)
class Simplex:
    """Pivots as the corners of a simplex; a point is the apex over it.

    The first coordinates of an apex are those of its foot in the space of the pivots,
    the last is its height over that space. Two points are at least as far apart as
    their apexes, and at most as far as if their heights pointed opposite ways.
    """

    pivots: np.ndarray
    base: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray, pivots: int) -> Simplex:
        """Chosen among ``points``: each pivot the farthest from the space of those before it."""
        chosen, height = [0], ((points - points[0]) ** 2).sum(1).astype(np.float64)
        limit = height.max(initial=0) * 1e-3
        while len(chosen) <= pivots and height.max(initial=0) > max(limit, 1.0):
            chosen.append(int(height.argmax()))
            found = cls._of(points[chosen])
            apex = found.apexes(points)
            height = apex[:, -1] ** 2
        return cls._of(points[chosen[:pivots]])

    @classmethod
    def _of(cls, pivots: np.ndarray) -> Simplex:
        edges = (pivots[1:] - pivots[0]).astype(np.float64)
        return cls(pivots, np.linalg.cholesky(edges @ edges.T) if len(edges) else np.zeros((0, 0)))

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each pivot, as floats of exact integers."""
        out = np.empty((len(points), len(self.pivots)))
        for k, pivot in enumerate(self.pivots):
            out[:, k] = ((points - pivot) ** 2).sum(1)
        return out

    def apexes(self, points: np.ndarray) -> np.ndarray:
        """Foot and height of each point, from its distances to the pivots only."""
        squared = self.distances(points)
        corners = (self.base**2).sum(1)
        right = (squared[:, :1] - squared[:, 1:] + corners) / 2
        foot = np.linalg.solve(self.base, right.T).T if len(self.base) else right
        height = np.sqrt(np.maximum(squared[:, 0] - (foot**2).sum(1), 0))
        return np.column_stack([foot, height])

    @staticmethod
    def bounds(apexes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance of each point to each other point."""
        feet = ((apexes[:, None, :-1] - others[None, :, :-1]) ** 2).sum(2)
        a, b = apexes[:, None, -1], others[None, :, -1]
        off = SLACK * ((apexes**2).sum(1)[:, None] + (others**2).sum(1)[None, :]) + 1
        return feet + (a - b) ** 2 - off, feet + (a + b) ** 2 + off


def nearest(points: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each point, ties to the smaller number.

    Centroids whose lower bound is over the least upper bound are passed over, and those
    whose lower bound is over the distance to the one with the least lower bound; the
    others are compared in whole numbers.
    """
    number, squared = np.empty(len(points), np.int32), np.empty(len(points), np.int64)
    corners = simplex.apexes(centroids)
    for start in range(0, len(points), ROWS_AT_ONCE):
        here = slice(start, start + ROWS_AT_ONCE)
        low, high = simplex.bounds(apexes[here], corners)
        guessed = ((points[here] - centroids[low.argmin(1)]) ** 2).sum(1)
        row, candidate = np.nonzero(low <= np.minimum(high.min(1), guessed)[:, None])
        exact = np.full(low.shape, np.iinfo(np.int64).max)
        exact[row, candidate] = ((points[here][row] - centroids[candidate]) ** 2).sum(1)
        number[here] = exact.argmin(1)
        squared[here] = exact.min(1)
    return number, squared


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A list column whose lists have one length as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return values.reshape(len(column), -1)


def whole_vectors(vectors: DataFrame, vector: str, components: int = COMPONENTS, scale: int = 256) -> DataFrame:
    """Rows whose vector has exactly so many components, none null or not finite, as integers.

    Each component x becomes floor(scale * x). A component beyond ``LARGEST`` then is an
    error: squared distances would not fit a long.
    """
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    fits = F.forall(vector, lambda v: F.abs(v) <= LARGEST)
    whole = F.when(fits, F.col(vector)).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST}")))
    kept = vectors.where((F.size(x) == components) & F.coalesce(finite, F.lit(False)))
    return kept.withColumn(vector, scaled).withColumn(vector, whole.cast("array<long>"))


@dataclass(frozen=True)
class Clustering:
    """Rows with cluster and distance, and the final centroids in the order of their numbers."""

    rows: DataFrame
    centroids: np.ndarray


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    pivots: int = PIVOTS,
    salt: str = "2:",
) -> Clustering:
    """Lloyd's rounds in whole numbers over every vector of ``vectors``.

    The first centroids are the vectors with the least SHA-256 of ``salt`` and id; rows
    that share an id are told apart by their components, a null id counts as no text. With
    fewer vectors there are fewer centroids, without any the result is empty. Vectors of
    another length, null ones and those with a component that is null or not finite are
    left out; rows that repeat count each. Columns other than id and vector are not read.

    Vectors are never shuffled: whole components and apexes are stored once, a round
    reads them and sends one sum per task and cluster. Centroids (``clusters`` rows) are
    all that comes to the driver.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("x")), "x")
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(digest, "x").limit(clusters).select("x").collect()  # ``clusters`` rows
    id_type = rows.schema["id"].dataType.simpleString()
    if not first:
        empty = spark.createDataFrame([], f"id {id_type}, cluster int, distance long")
        return Clustering(empty, np.zeros((0, COMPONENTS), np.int64))
    centroids = np.array([r["x"] for r in first], np.int64)
    simplex = Simplex.over(centroids, pivots)

    def with_apexes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apexes = simplex.apexes(_matrix(batch.column("x"), np.int64))
                ends = pa.array(np.arange(len(apexes) + 1, dtype=np.int32) * apexes.shape[1])
                lists = pa.ListArray.from_arrays(ends, pa.array(apexes.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["id", "x", "apex"])

    path = scratch_path(spark, "apexes")
    cached = store_at(rows.mapInArrow(with_apexes, f"id {id_type}, x array<long>, apex array<double>"), path)

    def assigned(batch: pa.RecordBatch, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points = _matrix(batch.column("x"), np.int64)
        return points, *nearest(points, _matrix(batch.column("apex"), np.float64), now, simplex)

    def moved(now: np.ndarray) -> np.ndarray:
        """Centroids after every vector went to its nearest."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
            for batch in batches:
                if batch.num_rows:
                    points, number, _ = assigned(batch, now)
                    order = np.argsort(number, kind="stable")
                    met, start = np.unique(number[order], return_index=True)
                    total[met] += np.add.reduceat(points[order], start, axis=0)
                    count += np.bincount(number, minlength=len(now))
            met = np.flatnonzero(count)
            ends = pa.array(np.arange(len(met) + 1, dtype=np.int32) * now.shape[1])
            lists = pa.ListArray.from_arrays(ends, pa.array(total[met].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(count[met]), lists], names=["cluster", "n", "total"])

        partial = cached.select("x", "apex").mapInArrow(sums, "cluster int, n long, total array<long>")
        wide = "decimal(38,0)"
        figures = partial.groupBy("cluster").agg(
            F.sum("n").alias("n"),
            F.array(*[F.sum(F.col("total")[i].cast(wide)) for i in range(now.shape[1])]).alias("total"),
        )
        after = now.copy()
        for r in figures.collect():  # one row per cluster
            after[r["cluster"]] = [int(t) // r["n"] for t in r["total"]]
        return after

    for _ in range(rounds):
        centroids = moved(centroids)
    last = centroids

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, number, squared = assigned(batch, last)
                columns = [batch.column("id"), pa.array(number), pa.array(squared)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])

    found = store(cached.mapInArrow(final, f"id {id_type}, cluster int, distance long"), "clusters")
    discard(spark, path)
    return Clustering(found, last)


def with_inertia(found: Clustering) -> DataFrame:
    """(id, cluster, distance) with the inertia of its cluster and of all, and the centroid's SHA-256."""
    spark = found.rows.sparkSession
    total = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    inertia = {r["cluster"]: int(r["total"]) for r in found.rows.groupBy("cluster").agg(total).collect()}  # one row per cluster
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in found.centroids]
    per_cluster = spark.createDataFrame(
        [(k, n, sum(inertia.values()), digests[k]) for k, n in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # One row per cluster.
    return found.rows.join(F.broadcast(per_cluster), "cluster")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_inertia(cluster(read_table(spark, sf_dir, "embeddings")))
    return found.select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _op12_sql(components: int = COMPONENTS, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """Every distance of every round, one common table expression each."""

    def assignment(k: int) -> str:
        return f"""
a{k} AS MATERIALIZED (
  SELECT rid, arg_min(c, d * {clusters} + c) AS c, min(d) AS d
  FROM (SELECT v.rid, m.c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN c{k} m USING (i) GROUP BY v.rid, m.c)
  GROUP BY rid
)"""

    def update(k: int) -> str:
        return f"""
c{k + 1} AS MATERIALIZED (
  SELECT o.c, o.i, coalesce(CASE WHEN n > 0 THEN (t - ((t % n) + n) % n) // n END, o.x) AS x
  FROM c{k} o LEFT JOIN (SELECT a.c, v.i, sum(v.x)::BIGINT AS t, count(*) AS n FROM a{k} a JOIN v USING (rid) GROUP BY a.c, v.i) s
  ON o.c = s.c AND o.i = s.i
)"""

    steps = [part for k in range(rounds) for part in (assignment(k), update(k))] + [assignment(rounds)]
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {components}
),
w AS MATERIALIZED (
  SELECT rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS xs FROM e
),
v AS MATERIALIZED (SELECT rid, unnest(range(1, {components + 1})) AS i, unnest(xs) AS x FROM w),
f AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), xs) - 1 AS c, xs FROM w
  QUALIFY c < {clusters}
),
c0 AS MATERIALIZED (SELECT c, unnest(range(1, {components + 1})) AS i, unnest(xs) AS x FROM f),
{','.join(steps)},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY c)
SELECT w.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance,
       (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
       h.sha AS centroid_sha256
FROM a{rounds} a JOIN w USING (rid) JOIN h USING (c)
"""


OP12_SQL = _op12_sql()
