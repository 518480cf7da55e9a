"""Bounds by pivots, and clustering against plain sums of squares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightlag.llm import centroids as cl
from tests.compare import connect, difference
from tests.llm import brute


def points(n, spread, seed, dims=64):
    return np.random.default_rng(seed).integers(-spread, spread + 1, (n, dims))


@pytest.mark.parametrize("spread", [0, 1, 40, 256, 100_000])
def test_bounds_hold_the_distance(spread):
    a, b = points(200, spread, 1), points(40, spread, 2)
    simplex = cl.Simplex.over(b, 12)
    low, high = simplex.bounds(simplex.apexes(a), simplex.apexes(b))
    exact = ((a[:, None] - b[None]) ** 2).sum(2)
    assert (low <= exact).all() and (exact <= high).all()


@pytest.mark.parametrize("pivots", [1, 2, 12, 100])
def test_nearest_is_that_of_all_distances(pivots):
    centers = points(40, 200, 3)
    centers[7] = centers[3]  # a tie
    near = np.concatenate([centers + points(40, 20, 4), centers, points(300, 200, 5)])
    simplex = cl.Simplex.over(centers, pivots)
    number, squared = cl.nearest(near, simplex.apexes(near), centers, simplex)
    exact = ((near[:, None] - centers[None]) ** 2).sum(2)
    assert (number == exact.argmin(1)).all() and (squared == exact.min(1)).all()


def test_bounds_leave_few_candidates(monkeypatch):
    centers = points(40, 200, 6)
    near = np.repeat(centers, 25, 0) + points(1_000, 20, 7)
    simplex = cl.Simplex.over(centers, 12)
    apexes, low_of = simplex.apexes(near), []
    bounds = cl.Simplex.bounds
    monkeypatch.setattr(cl.Simplex, "bounds", staticmethod(lambda a, b: low_of.append(bounds(a, b)) or low_of[-1]))
    _, squared = cl.nearest(near, apexes, centers, simplex)
    assert (low_of[0][0] <= squared[:, None]).sum(1).mean() < 2


@pytest.fixture(params=["given", "awkward", "empty"])
def folder(request, sf_dir, awkward_dir, empty_dir):
    return {"given": sf_dir, "awkward": awkward_dir, "empty": empty_dir}[request.param]


def test_rows_of_its_sql(spark, folder):
    assert difference(cl.op12_centroids(spark, folder), connect(folder), cl.OP12_SQL) is None


def test_other_columns_may_have_any_name(spark, awkward_dir):
    vectors = spark.read.parquet(f"{awkward_dir}/embeddings.parquet")
    wide = vectors.withColumns({n: F.lit(1) for n in ["id", "x", "apex", "cluster", "n", "total"]})
    assert brute.rows_of(cl.cluster(wide).rows) == brute.rows_of(cl.cluster(vectors).rows)


def test_a_component_out_of_bounds_is_told(spark):
    vectors = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="a component is beyond"):
        cl.cluster(vectors)
