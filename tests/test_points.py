"""Whole slices: costs that are never held give the matrix's assignment, and alignment without a sample recovers what samples missed."""

import math
import tracemalloc
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from slabwise import model
from slabwise.operators import points, registration, transport
from slabwise.session import ship


@pytest.mark.parametrize("kind", ["near", "far", "equal"])
@pytest.mark.parametrize("ties", [1, 1e4])
def test_assignment_is_that_of_the_matrix(monkeypatch, kind, ties):
    rng, n = np.random.default_rng(1), 300
    a = rng.normal(size=(n, 5))
    b = {"near": lambda: a[rng.permutation(n)] + 0.3 * rng.normal(size=(n, 5)), "far": lambda: rng.normal(size=(n, 5)) + 9, "equal": lambda: rng.integers(0, 2, (n, 5)).astype(float)}[kind]()
    p, q = rng.normal(size=(n, 2)), rng.normal(size=(n, 2)) + 4
    whole, made = transport.Costs.of(a, b).cleaned().tie_broken(), points.Points(a, b).tie_broken()
    assert np.isclose(whole.ties, made.ties)
    whole, made = replace(whole, ties=ties * whole.ties).gated(p, q, 0.7), replace(made, ties=ties * made.ties).gated(p, q, 0.7)
    cost = whole.rows(0, n)
    monkeypatch.setattr(transport, "ENTRIES", 2000)
    to, want = transport.assignment(made), transport.assignment(cost)
    assert sorted(to) == list(range(n)) and np.isclose(cost[np.arange(n), to].sum(), cost[np.arange(n), want].sum(), rtol=1e-10)


@pytest.mark.parametrize("n,m,k", [(3000, 2500, 10), (1000, 77, 10), (300, 5, 10), (2, 900, 1)])
def test_nearest_in_the_plane(n, m, k):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(n, 2)), np.concatenate([rng.normal(size=(m - 2, 2)), [[50.0, 50.0]] * 2])
    d = np.sort(((a[:, None] - b[None]) ** 2).sum(2), axis=1)[:, :k]
    assert np.allclose(np.sort(points.nearest_in_plane(a, b, k), axis=1), d)


def test_a_whole_slice_is_assigned_without_its_matrix():
    rng, n = np.random.default_rng(3), 12_000
    v, xy = 30 * rng.normal(size=(n, 8)), 3 * rng.normal(size=(n, 2))
    one = registration.Block(np.arange(n), xy, v)
    turned = registration.Block(np.arange(n), xy @ registration.rotation(0.9).T + [2, -2], v)
    options = registration.Options(expr_knn=None, subsample_n=None, emd_max_n=None)
    tracemalloc.start()
    s, r, t, far, name = registration.register(turned, one, options)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(math.atan2(r[1, 0], r[0, 0]) + 0.9) < 1e-6 and far < 1e-9 and name.startswith("coarse_emd")
    assert peak < 300e6  # the matrix takes 1,152 MB


def test_alignment_takes_all_spots(spark):
    """Two copies of 2,500 spots: samples of 2,000 don't hold the same spots of both."""
    ship(spark)
    rng, n = np.random.default_rng(4), 2500
    v = rng.normal(size=(n, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    xy = 10 * v[:, :2]
    moved = xy @ registration.rotation(0.3).T + [2, -2]
    both = np.concatenate([xy, moved])
    df = spark.createDataFrame(pa.table({"gid": np.concatenate([np.arange(n), 10_000_000 + np.arange(n)]), "slice_idx": np.repeat(np.arange(2, dtype=np.int32), n), "x": both[:, 0], "y": both[:, 1], "vec": pa.array(list(np.concatenate([30 * v] * 2)))}))
    cube = model.Cube(df.select("gid", "slice_idx", "x", "y"), embedding=df.select("gid", "slice_idx", "vec"))
    options = registration.Options(svd_dim=8, feature_mode="svd", expr_knn=None, n_iter=3, subsample_n=None, emd_max_n=None)
    moved, results, poses = registration.align_adjacent(cube, options)
    (pose,) = poses.collect()
    assert abs(pose["theta"] + 0.3) < 1e-6 and results[0].method == "coarse_emd_rigid_spatial" and results[0].chamfer_xy < 1e-9
    got = np.array([(r.x, r.y) for r in moved.spots.filter("slice_idx = 1").orderBy("gid").collect()])
    assert np.abs(got - xy).max() < 1e-6
