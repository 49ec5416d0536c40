"""Transport on each row's candidates against the same costs as a full matrix."""

import tracemalloc
import warnings

import numpy as np
import pytest

from slabwise.operators import registration, transport


def full(a, b, k, clip, pairwise):
    """The cleaned cost, entry by entry."""
    d = transport.squared_distances(a, b)
    out = np.empty_like(d)
    for i, row in enumerate(d):
        kept = set(np.argsort(row, kind="stable")[:k].tolist()) if 0 < (k or 0) < len(row) else set(range(len(row)))
        limit = np.inf if clip is None else np.quantile([row[j] for j in sorted(kept)], clip)
        kept = {j for j in kept if row[j] <= limit}
        top = max(row[j] for j in kept)
        cap = max(10 * (1.0 if pairwise and top <= 0 else top), 1.0)
        filled = np.array([row[j] if j in kept else cap for j in range(len(row))])
        out[i] = filled - filled.min()
    return out


@pytest.fixture(params=[1 << 22, 70])
def entries(request, monkeypatch):
    monkeypatch.setattr(transport, "ENTRIES", request.param)


@pytest.mark.parametrize("k,clip,pairwise", [(None, None, True), (0, 0.7, True), (6, None, True), (6, 0.5, False), (1, None, False), (99, 0.3, True)])
def test_costs_equal_the_full_matrix(entries, k, clip, pairwise):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 3, (30, 3)).astype(float), rng.integers(0, 3, (23, 3)).astype(float)  # many ties
    want = full(a, b, k, clip, pairwise)
    c = transport.Costs.of(a, b, k).cleaned(clip, pairwise)
    assert np.allclose(c.rows(0, 30), want) and np.allclose(c[7], want[7])
    p, q = rng.normal(size=(30, 2)), rng.normal(size=(23, 2))
    i, j = np.indices(want.shape)
    assert np.allclose(c.tie_broken().rows(4, 9), (want + 1e-6 * max(want.max(), 1) * (i - j) ** 2)[4:9])
    assert np.allclose(c.gated(p, q, 2.0).rows(0, 30), want + 0.2 * transport.squared_distances(p, q) / 4)
    for variant, dense in ((c, want), (c.gated(p, q, 2.0), want + 0.2 * transport.squared_distances(p, q) / 4)):
        for reg, reg_m in ((0.5, None), (0.5, 10.0), (0.01, 10.0)):
            pi = transport.sinkhorn(np.full(30, 1 / 30), np.full(23, 1 / 23), dense, reg, reg_m, 40, 0.0)
            w, sums = transport.entropic_move(variant, q, reg, reg_m, 40, 0.0)
            assert np.allclose(w, pi.sum(1), rtol=1e-9, atol=1e-12) and np.allclose(sums, pi @ q, rtol=1e-9, atol=1e-12)


def test_assignment_by_rows_equals_that_of_the_matrix(entries):
    rng = np.random.default_rng(4)
    a, b, q = rng.normal(size=(40, 4)), rng.normal(size=(40, 4)), rng.normal(size=(40, 2))
    c = transport.Costs.of(a, b, 5).cleaned().tie_broken().gated(q, q, 1.5)
    to = transport.assignment(c.rows(0, 40))
    assert (transport.assignment(c) == to).all()
    w, mean, method = transport.barycentric_move(c, q, "emd", 0.05)
    assert method == "emd" and np.allclose(w, 1 / 40) and np.allclose(mean, q[to])


def test_hygiene_and_names():
    none = transport.Costs(np.array([[0], [1]]), np.full((2, 1), np.inf), np.full(2, np.inf), 2)
    with pytest.raises(RuntimeError):
        none.cleaned()
    one = transport.Costs(np.array([[0], [1]]), np.array([[1.0], [np.inf]]), np.full(2, np.inf), 2).cleaned()
    assert one.rows(0, 2).tolist() == [[0.0, 9.0], [0.0, 0.0]]
    with pytest.raises(ValueError):
        transport.barycentric_move(one, np.zeros((2, 2)), "odd", 0.1)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert transport.barycentric_move(one, np.zeros((2, 2)), "lap", 0.1, emd_max_n=1)[2] == "sinkhorn"
    assert seen


def test_chamfer_spacing_and_nearest_by_blocks(entries):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(31, 2)), rng.normal(size=(17, 2))
    d = transport.squared_distances(a, b)
    assert np.isclose(registration.chamfer_of(a, b), d.min(1).mean() + d.min(0).mean())
    assert (transport.nearest(a, b) == d.argmin(1)).all()
    near = np.sort(transport.squared_distances(a, a), axis=1)[:, :10]
    assert np.isclose(registration.target_spacing(a), np.median(np.sqrt(near)))


def test_memory_of_twenty_thousand_spots():
    """The full matrix would take 3.2 GB; candidates take 20,000 x 20 entries and a block of rows."""
    rng = np.random.default_rng(6)
    a = rng.normal(size=(20_000, 8))
    b, xy = a[rng.permutation(20_000)] + 0.01 * rng.normal(size=a.shape), rng.normal(size=(20_000, 2))
    tracemalloc.start()
    c = transport.Costs.of(a, b, 20).cleaned()
    w, sums = transport.entropic_move(c, xy, 0.05, 10.0, 30, 0.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert w.shape == (20_000,) and np.isfinite(sums).all()
    assert peak < 400e6


@pytest.mark.parametrize("reg_m", [None, 10.0])
def test_rounds_of_a_held_cost_are_products_with_vectors(monkeypatch, reg_m):
    """Two exponentials of every entry a round took align_adjacent over a thousand seconds; the plan is that of the log domain."""
    rng = np.random.default_rng(7)
    a, b, q = rng.normal(size=(60, 4)), rng.normal(size=(47, 4)), rng.normal(size=(47, 2))
    c = transport.Costs.of(a, b, 12).cleaned().gated(rng.normal(size=(60, 2)), q, 1.0)
    k, f, g, la, lb = c.rows(0, 60) / -0.05, np.zeros(60), np.zeros(47), -np.log(60), -np.log(47)
    power = 1.0 if reg_m is None else reg_m / (reg_m + 0.05)
    for _ in range(500):
        f = -power * transport.logsumexp(k + g + lb, 1)
        g = -power * transport.logsumexp(k + (f + la)[:, None], 0)
    plan = np.exp(k + (f + la)[:, None] + g + lb)
    calls, log = [], transport.logsumexp
    monkeypatch.setattr(transport, "logsumexp", lambda x, axis: calls.append(1) or log(x, axis))
    w, sums = transport.entropic_move(c, q, 0.05, reg_m, 500, 0.0)
    assert np.allclose(w, plan.sum(1), rtol=1e-8, atol=1e-13) and np.allclose(sums, plan @ q, rtol=1e-8, atol=1e-13)
    assert len(calls) < 100


def test_assignment_makes_rows_once_and_searches_for_few(monkeypatch):
    rng = np.random.default_rng(8)
    a, q = rng.normal(size=(80, 4)), rng.normal(size=(80, 2))
    c = transport.Costs.of(a, a[rng.permutation(80)] + 0.01 * rng.normal(size=a.shape), 9).cleaned().gated(q, q, 1.5)
    asked, rows = [], transport.Costs.rows
    monkeypatch.setattr(transport.Costs, "rows", lambda self, low, high: asked.append(high - low) or rows(self, low, high))
    to = transport.assignment(c)
    assert sorted(to) == list(range(80)) and sum(asked) <= 160


def test_assigned_pair_never_holds_the_square():
    """The square of 6,000 rows took 288 MB, and its distances as much again."""
    import pandas as pd

    rng = np.random.default_rng(9)
    v = rng.normal(size=(6000, 4))
    gid = np.arange(6000)
    rows = pd.concat([pd.DataFrame({"side": 0, "gid": gid, "vec": list(v)}), pd.DataFrame({"side": 1, "gid": 10_000 - gid, "vec": list(v)}).iloc[:-7]])
    tracemalloc.start()
    found = transport.assigned_pair(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 5993 and (found["dst"] == 10_000 - found["src"]).all()
    assert peak < 250e6
