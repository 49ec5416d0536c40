"""The shortest path by levels of grouped minima."""

import itertools

import numpy as np
import pytest

from slabwise.model import OrderConfig
from slabwise.operators import ordering


def rows_of(spark, d):
    rows = [(i, j, float(d[i, j])) for i in range(len(d)) for j in range(len(d)) if i != j]
    return spark.createDataFrame(rows, "i int, j int, d double")


def distances(n, seed):
    p = np.random.default_rng(seed).normal(size=(n, 3))
    return np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))


@pytest.mark.parametrize("n", [3, 5, 7])
def test_path_equals_brute_force(spark, n):
    d = distances(n, n)
    path = ordering.shortest_path(rows_of(spark, d))
    least = min(ordering.path_cost(d, p) for p in itertools.permutations(range(n)))
    assert sorted(path) == list(range(n)) and abs(ordering.path_cost(d, path) - least) < 1e-12
    assert path == ordering.held_karp(d) and path[-1] < path[0]
    assert ordering.shortest_path(rows_of(spark, d), canonical=True) == path[::-1]


def test_ties_and_few_nodes(spark):
    assert ordering.shortest_path(rows_of(spark, np.ones((5, 5)))) == ordering.held_karp(np.ones((5, 5)) - np.eye(5))
    assert ordering.shortest_path(rows_of(spark, np.ones((2, 2)))) == [0, 1]
    assert ordering.shortest_path(rows_of(spark, np.ones((1, 1)))) == []


def test_sixteen_slices(spark):
    """523,000 states; a line in another order is found again."""
    place = np.random.default_rng(3).permutation(16)
    d = np.abs(place[:, None] - place[None]).astype(float)
    path = ordering.shortest_path(rows_of(spark, d))
    assert [int(place[i]) for i in path] in (list(range(16)), list(range(15, -1, -1))) and path[-1] < path[0]


def test_no_path(spark):
    parts = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "i int, j int, d double")
    with pytest.raises(ValueError):
        ordering.shortest_path(parts)


@pytest.mark.parametrize("use_ot", [True, False])
def test_order_of_a_line_of_slices(spark, use_ot):
    """Slices of unequal size along a line; the similarity's denominator is the lesser slice's."""
    rng = np.random.default_rng(5)
    rows = [(100 * s + i, s, [0.6 * ((s * 3) % 5) + float(a), float(b), 1.0]) for s in range(5) for i, (a, b) in enumerate(rng.normal(0, 0.5, (20 + 4 * s, 2)))]
    features = spark.createDataFrame(rows, "gid long, slice_idx int, vec array<double>")
    path = ordering.infer_order(features, OrderConfig(svd_dim=3, knn=8, use_ot=use_ot))
    assert [(s * 3) % 5 for s in path] in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0])
