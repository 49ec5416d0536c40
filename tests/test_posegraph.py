"""The pose graph from moments against the same least squares over all correspondences."""

import numpy as np
import pytest

from slabwise.operators import posegraph
from slabwise.operators.registration import rotation


def correspondences(n, far=0.0, seed=0):
    rng, out = np.random.default_rng(seed), {}
    for i in range(n - 1):
        p = rng.normal(0, 3, (40, 2)) + far
        q = p @ rotation(0.2 + 0.1 * i).T + rng.normal(0, 0.3, (40, 2)) + [1.0, i]
        out[i] = p, q, rng.random(40)
    return out


def moments_of(spark, found):
    rows = [(i, *map(float, (*a, *b, c))) for i, (p, q, w) in found.items() for a, b, c in zip(p, q, w)]
    df = spark.createDataFrame(rows, "pair int, px double, py double, qx double, qy double, w double")
    return {r["pair"]: posegraph.Moments.of(r) for r in posegraph.moments(df, ["pair"]).collect()}


def residuals(found, x, anchor, lam):
    parts = [(np.sqrt(w)[:, None] * (p @ rotation(x[i + 1, 0]).T + x[i + 1, 1:] - q @ rotation(x[i, 0]).T - x[i, 1:])).ravel() for i, (p, q, w) in found.items()]
    parts += [np.sqrt(lam) * (x[i + 1] - x[i]) for i in range(len(x) - 1) if anchor not in (i, i + 1)]
    return np.concatenate(parts)


def dense(found, n, anchor, lam):
    """Gauss-Newton by finite differences on all correspondences."""
    x, free = np.zeros((n, 3)), [i for i in range(n) if i != anchor]
    x[:, 0] = [-0.3 * (i - anchor) for i in range(n)]
    for _ in range(200):
        e, jac = residuals(found, x, anchor, lam), []
        for i in free:
            for k in range(3):
                y = x.copy()
                y[i, k] += 1e-6
                jac.append((residuals(found, y, anchor, lam) - e) / 1e-6)
        jac = np.stack(jac, 1)
        x[free] += 0.5 * np.linalg.lstsq(jac, -e, rcond=None)[0].reshape(-1, 3)
    return x


@pytest.mark.parametrize("anchor,lam", [(0, 0.0), (2, 0.0), (0, 5.0), (2, 0.5), (4, 100.0)])
def test_solution_equals_dense_least_squares(spark, anchor, lam):
    found = correspondences(5)
    x, cost, _ = posegraph.solve(moments_of(spark, found), 5, anchor, lam, 200)
    want = dense(found, 5, anchor, lam)
    e = residuals(found, x, anchor, lam)
    assert abs(cost - 0.5 * e @ e) < 1e-9 * max(1.0, cost)
    assert cost <= 0.5 * (residuals(found, want, anchor, lam) ** 2).sum() + 1e-9
    assert np.abs(x - want).max() < 1e-4


def test_normal_equations_are_those_of_the_residuals(spark):
    found = correspondences(2)
    x = np.array([[0.3, 1.0, -2.0], [0.9, 0.5, 4.0]])
    jac = []
    for i in (1, 0):
        for k in range(3):
            up, down = x.copy(), x.copy()
            up[i, k] += 1e-5
            down[i, k] -= 1e-5
            jac.append((residuals(found, up, 0, 0.0) - residuals(found, down, 0, 0.0)) / 2e-5)
    jac, e = np.stack(jac, 1), residuals(found, x, 0, 0.0)
    hh, ll, hl, gh, gl = moments_of(spark, found)[0].normal(x[1], x[0])
    assert np.allclose(np.block([[hh, hl], [hl.T, ll]]), jac.T @ jac, rtol=1e-6, atol=1e-5)
    assert np.allclose(np.concatenate([gh, gl]), jac.T @ e, rtol=1e-6, atol=1e-5)


def test_exact_second_derivatives(spark):
    m = moments_of(spark, correspondences(2))[0]
    x, h = np.array([0.9, 0.5, 4.0, 0.3, 1.0, -2.0]), 1e-3
    f = lambda y: 0.5 * m.cost(y[:3], y[3:])
    e = h * np.eye(6)
    want = [[(f(x + a + b) - f(x + a - b) - f(x - a + b) + f(x - a - b)) / (4 * h * h) for b in e] for a in e]
    hh, ll, hl, _, _ = m.normal(x[:3], x[3:], exact=True)
    assert np.allclose(np.block([[hh, hl], [hl.T, ll]]), want, rtol=1e-4, atol=1e-3)


def test_far_coordinates_cost_no_digits(spark):
    """Moments about the means: correspondences 1e6 from the origin give the same turns."""
    near, far = (posegraph.solve(moments_of(spark, correspondences(4, f)), 4, 0)[0] for f in (0.0, 1e6))
    assert np.abs(near[:, 0] - far[:, 0]).max() < 1e-8


def test_missing_links_leave_slices(spark):
    found = correspondences(5)
    del found[2]
    x, _, _ = posegraph.solve(moments_of(spark, found), 5, 0)
    assert np.all(x[3:] == 0) and np.all(x[2] != 0)


def test_block_tridiagonal_solve():
    rng = np.random.default_rng(1)
    a = np.zeros((12, 12))
    above = rng.normal(size=(3, 3, 3))
    diagonal = np.stack([m @ m.T + 10 * np.eye(3) for m in rng.normal(size=(4, 3, 3))])
    for i in range(4):
        a[3 * i : 3 * i + 3, 3 * i : 3 * i + 3] = diagonal[i]
        if i < 3:
            a[3 * i : 3 * i + 3, 3 * i + 3 : 3 * i + 6] = above[i]
            a[3 * i + 3 : 3 * i + 6, 3 * i : 3 * i + 3] = above[i].T
    r = rng.normal(size=(4, 3))
    assert np.allclose(posegraph.tridiagonal(diagonal, above, r).ravel(), np.linalg.solve(a, r.ravel()))
