"""Exact neighbours by metric pruning: equal to brute force, and most groups never met where features are clustered."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slabwise.operators import metric, neighbors
from slabwise.session import ship

SCHEMA = "part int, gid long, vec array<double>"


def frame(spark, rows):
    return spark.createDataFrame([(p, g, [float(x) for x in v]) for p, g, v in rows], SCHEMA)


def brute(sources, targets, k):
    out = set()
    for p in {s[0] for s in sources}:
        t = [(g, v) for q, g, v in targets if q == p]
        if not t:
            continue
        ids, m = np.array([g for g, _ in t]), np.array([v for _, v in t], dtype=float)
        for _, g, v in (s for s in sources if s[0] == p):
            d = ((m - np.array(v, dtype=float)) ** 2).sum(axis=1)
            order = [j for j in np.lexsort((ids, d)) if ids[j] != g][:k]
            out |= {(p, g, int(ids[j]), float(d[j]), r + 1) for r, j in enumerate(order)}
    return out


def clustered(n, parts=2, dim=12, spots=40, seed=0, first=0):
    rng = np.random.default_rng(seed)
    centre = np.random.default_rng(99).standard_normal((spots, dim)) * 6
    return [(i % parts, first + i, centre[rng.integers(spots)] + rng.standard_normal(dim) * 0.4) for i in range(n)]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def test_clustered_features_meet_few_groups(spark):
    t, s = clustered(3000), clustered(600, seed=1, first=10_000)
    found, home, others, held = metric.nearest(frame(spark, s), frame(spark, t), 5, 64)
    got = {(r.part, r.src, r.dst, r.d2, r["rank"]) for r in found.collect()}
    assert got == brute(s, t, 5)
    pairs = sum(held.groups[p] for p, _, _ in s)
    met = home.count() + others.count()
    assert min(held.groups.values()) >= 20 and met < 0.3 * pairs


def test_spread_features_are_still_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(0, i, rng.standard_normal(16)) for i in range(1200)]
    found, home, others, held = metric.nearest(frame(spark, rows), frame(spark, rows), 6, 100)
    assert {(r.part, r.src, r.dst, r.d2, r["rank"]) for r in found.collect()} == brute(rows, rows, 6)
    assert home.count() + others.count() <= held.groups[0] * 1200  # hardly any group is spared, and none is met twice


def test_ties_copies_and_short_parts(spark):
    rng = np.random.default_rng(3)
    rows = [(0, i, rng.integers(-1, 2, 3)) for i in range(500)]  # 27 places: ties everywhere
    rows += [(0, 500 + i, [5, 5, 5]) for i in range(300)]  # one crowded place, spread over several groups
    rows += [(1, 900, [0, 0, 0]), (1, 901, [1, 0, 0]), (2, 950, [0, 0, 0])]  # parts of fewer than k
    t = [r for r in rows if r[0] < 2]
    got = neighbors.vector_knn(frame(spark, rows), frame(spark, t), 4, block=50).collect()
    assert {(r.part, r.src, r.dst, r.d2, r["rank"]) for r in got} == brute(rows, t, 4)
    whole = neighbors.vector_knn(frame(spark, rows), frame(spark, t), 4).collect()  # in one block
    assert {tuple(r) for r in whole} == {tuple(r) for r in got}
    none = frame(spark, rows).limit(0)
    assert neighbors.vector_knn(frame(spark, rows), none, 4, block=50).count() == 0 == neighbors.vector_knn(none, frame(spark, t), 4, block=50).count()


def test_far_and_near_distances_lose_no_digits(spark):
    rng = np.random.default_rng(4)
    rows = [(0, i, np.array([1e7, -1e7]) * (i % 3) + rng.standard_normal(2) * 1e-3) for i in range(600)]
    got = neighbors.vector_knn(frame(spark, rows), frame(spark, rows), 5, block=40).collect()
    assert {(r.part, r.src, r.dst, r.d2, r["rank"]) for r in got} == brute(rows, rows, 5)


def test_copies_of_a_source_grow_less_than_the_targets(spark):
    """Groups of one block each: a source was sent to 802 of them at 102,564 targets of block 128."""
    assert metric.group_size(2_000, 128) == 128
    for n in (102_564, 615_384):
        assert n / metric.group_size(n, 128) <= 65
    assert 50_000_000 / metric.group_size(50_000_000, 128) < 600
    rng = np.random.default_rng(5)
    rows = [(0, i, rng.standard_normal(8)) for i in range(1500)]
    found, _, _, held = metric.nearest(frame(spark, rows), frame(spark, rows), 4, 8)
    assert held.groups[0] <= 2 * metric.MOST_GROUPS
    assert {(r.part, r.src, r.dst, r.d2, r["rank"]) for r in found.collect()} == brute(rows, rows, 4)


def test_a_known_kth_distance_selects_by_itself(monkeypatch):
    """Where a source's k-th distance is known, a group is compared with it and nothing is selected or sorted but what lies within."""
    rng = np.random.default_rng(12)
    rows, vec, k = rng.normal(0, 30, (500, 16)), rng.normal(0, 30, (40, 16)), 5
    d = ((vec[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2)
    near = np.argsort(d, axis=1)[:, :k]
    kth = np.sqrt(np.take_along_axis(d, near, axis=1)[:, -1])

    def never(*_, **__):
        raise AssertionError("selected")

    monkeypatch.setattr(np, "partition", never)
    found = metric._nearest(pa.int32(), 0, np.arange(40) + 1000, vec, kth, np.arange(500), rows, k)
    assert found.column("src").to_pylist() == np.repeat(np.arange(40) + 1000, k).tolist()
    assert found.column("dst").to_pylist() == near.ravel().tolist()


def test_a_source_is_sent_to_a_bundle_of_groups_once(spark):
    """Features that spare no group: each source went once to every group, each time with its vector, and came back with k rows of each."""
    rng = np.random.default_rng(6)
    rows, k = [(p, p * 5000 + i, rng.standard_normal(24)) for p in range(2) for i in range(900)], 5
    found, home, others, held = metric.nearest(frame(spark, rows), frame(spark, rows), k, 20)
    assert {(r.part, r.src, r.dst, r.d2, r["rank"]) for r in found.collect()} == brute(rows, rows, k)
    groups = sum(held.groups.values())
    bundles = sum(math.ceil(n / held.fan) for n in held.groups.values())
    assert groups >= 80 and held.fan >= 5
    # each bundle at most once in each round; each group at most once in both, as before
    assert home.count() <= 900 * bundles and others.count() <= 900 * bundles
    assert home.count() + others.count() < 900 * groups / 2
    assert 900 * groups * 0.8 < sum(x.agg(F.sum(F.bit_count("bits"))).first()[0] for x in (home, others)) <= 900 * groups
    assert held.met(others, k).count() <= 900 * bundles * k


def test_bits_still_spare_groups_of_a_bundle(spark):
    t, s = clustered(3000), clustered(600, seed=1, first=10_000)
    _, home, others, held = metric.nearest(frame(spark, s), frame(spark, t), 5, 32)
    met = sum(x.agg(F.sum(F.bit_count("bits"))).first()[0] for x in (home, others))
    assert held.fan > 1 and met < 0.3 * sum(held.groups[p] for p, _, _ in s)


def test_bundles_stay_small_for_few_groups_and_bounded_for_many():
    assert metric.bundle_size(2048, 64, 540, 12) * 2048 * 64 <= metric.HELD
    assert metric.bundle_size(2048, 64, 20, 12) == 1 == metric.bundle_size(1 << 24, 64, 10**6, 12)
    assert metric.bundle_size(1, 2, 10**6, 12) == metric.MOST_BITS


def test_equal_vectors_take_no_matrix_of_their_differences():
    """All pairs of 256 sources and a block tie: their differences together took 268 MB, several times over."""
    n = neighbors.BLOCK
    table = pa.table({"part": pa.array([0] * 2 * n, pa.int32()), "side": pa.array([0] * n + [1] * n, pa.int32()), "gid": np.arange(2 * n), "vec": pa.array([[0.0] * 64] * (2 * n))})
    tracemalloc.start()
    got = neighbors._scored(table, 3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.column("dst").to_pylist() == [n, n + 1, n + 2] * n
    assert most < 120e6
