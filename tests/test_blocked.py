"""Products of a sparse matrix in row blocks against dense ones, and what they send."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slabwise.operators import blocked, linalg, neighbors
from slabwise.session import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def vectors(spark, z, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(range(len(z)) if ids is None else ids, z)], "gid long, vec array<double>")


def as_matrix(df, n, width):
    out, seen = np.zeros((n, width)), set()
    for r in df.collect():
        out[r.gid], _ = r.vec, seen.add(r.gid)
    return out, seen


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_products_equal_dense_ones(spark, block):
    rng = np.random.default_rng(1)
    n, width = 200, 5
    entries = [(int(i), int(j), float(w)) for i, j, w in zip(rng.integers(0, 190, 1500), rng.integers(0, n, 1500), rng.standard_normal(1500))]
    entries += [(3, j, 1.0) for j in range(n)] + [(i, 5, 2.0) for i in range(150)]  # a full row, a full column, and repeated entries
    a = np.zeros((n, n))
    for i, j, w in entries:
        a[i, j] += w
    z = rng.standard_normal((n, width))
    edges = spark.createDataFrame(entries, "src long, dst long, w double")
    ids = spark.range(n).select(F.col("id").alias("gid"))
    matrix = blocked.BlockedMatrix(edges, blocked.places_of_ids(ids, block))
    got, seen = as_matrix(matrix.product(vectors(spark, z)), n, width)
    assert np.allclose(got, a @ z) and seen == {i for i, _, _ in entries}
    # some columns have no vector: they count as nothing
    some = np.arange(0, n, 3)
    got, seen = as_matrix(matrix.product(vectors(spark, z[some], some)), n, width)
    assert np.allclose(got, a[:, some] @ z[some]) and seen == {i for i, j, _ in entries if j % 3 == 0}
    base = rng.standard_normal((n, width))
    mixed = matrix.times(matrix.vectors(vectors(spark, z)), matrix.fixed(vectors(spark, base[:195])), (0.3, 0.7, 0.1)).collect()
    has = np.isin(np.arange(n), [i for i, _, _ in entries])
    want = np.where(has[:, None], 0.3 * base + 0.7 * a @ z, 0.1 * base)
    assert len(mixed) == 195 and all(np.allclose(r.vec, want[r.gid]) and np.isclose(r.change, ((want - z)[r.gid] ** 2).sum()) and np.isclose(r["size"], (z[r.gid] ** 2).sum()) for r in mixed)


def test_empty_matrices_and_vectors(spark):
    edges = spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, w double")
    none = vectors(spark, np.zeros((0, 1)))
    assert linalg.sparse_product(edges, none).count() == 0
    assert linalg.sparse_product(edges.limit(0), vectors(spark, np.ones((3, 2)))).count() == 0
    assert linalg.diffuse(edges.limit(0), vectors(spark, np.ones((3, 2))), 0.5, 2).count() == 3


def test_blocks_of_spots_send_each_vector_hardly_twice(spark):
    rng = np.random.default_rng(2)
    n = 6000
    spots = spark.createDataFrame([(i, i % 2, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 100, (n, 2)))], "gid long, slice_idx int, x double, y double")
    edges = neighbors.knn_within(spots, 8).select("src", "dst", F.lit(1.0).alias("w"))
    matrix = blocked.BlockedMatrix(edges, blocked.places_of_spots(spots, 512))
    messages = matrix.sent.count()
    assert messages < 1.6 * n  # each step moves them and the entries: below twice the vectors and 12 bytes an entry
    held = sum(len(r.row) + len(r.w) for r in matrix.entries.collect())
    assert held == 12 * 8 * n


def test_a_step_is_one_shuffle(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 50, 1.0) for i in range(50)], "src long, dst long, w double")
    x = vectors(spark, np.eye(50))
    matrix = blocked.BlockedMatrix(edges, blocked.places_of_ids(x, 16))
    step = matrix.times(matrix.vectors(x), matrix.fixed(x), (0.5, 0.5, 0.5))
    from slabwise.session import cut

    plan = matrix.times(cut(step), matrix.plain)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Join" not in plan and "Aggregate" not in plan
