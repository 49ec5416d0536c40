"""Leiden: one rule in a task and by joins, connected and well-connected communities, no move that gains."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slabwise.operators import graph, leiden
from slabwise.session import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def both_ways(pairs):
    return [(a, b, x) for (a, b), x in pairs.items()] + [(b, a, x) for (a, b), x in pairs.items()]


def random_graph(seed, n=60, groups=12, inside=0.4, across=0.03):
    rnd = random.Random(seed)
    return both_ways({(7 * a, 7 * b): rnd.choice([1.0, 2.0]) for a in range(n) for b in range(a) if rnd.random() < (inside if a // groups == b // groups else across)})


def in_memory(edges, resolution=1.0, seed=0, passes=10):
    """Node -> community, by what a task does."""
    ids = np.unique([e[0] for e in edges])
    s, d, w = np.searchsorted(ids, [e[0] for e in edges]), np.searchsorted(ids, [e[1] for e in edges]), np.array([e[2] for e in edges])
    c = np.arange(len(ids))
    for turn in range(passes):
        found = leiden._descended(ids, s, d, w, np.zeros(len(ids)), c, resolution / w.sum(), 0, 10, f"{seed}/{turn}")
        new = leiden._split(ids, s, d, np.searchsorted(ids, found))
        if (new == c).all():
            break
        c = new
    return dict(zip(ids.tolist(), c.tolist()))


def partition(of):
    groups = {}
    for v, c in of.items():
        groups.setdefault(c, set()).add(v)
    return {frozenset(g) for g in groups.values()}


def quality(edges, of, resolution=1.0):
    k, twice = {}, sum(x for _, _, x in edges)
    for a, _, x in edges:
        k[a] = k.get(a, 0) + x
    mass = {}
    for v, c in of.items():
        mass[c] = mass.get(c, 0) + k[v]
    return sum(x for a, b, x in edges if of[a] == of[b]) / twice - resolution * sum(m * m for m in mass.values()) / twice**2


@pytest.mark.parametrize("seed", range(6))
def test_communities_are_connected_and_no_single_move_gains(seed):
    edges = random_graph(seed)
    found = in_memory(edges)
    q = quality(edges, found)
    for v in found:
        for c in {*found.values(), -1}:
            assert quality(edges, {**found, v: c}) <= q + 1e-9
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
    for own in partition(found):
        seen, stack = set(), [min(own)]
        while stack:
            x = stack.pop()
            seen.add(x)
            stack += (near[x] & own) - seen
        assert seen == own
    assert len(partition(found)) >= 4


def test_refined_communities_are_well_connected():
    """What refinement joins gains, and each refined community was tied to the rest of its community as the rule asks when it was joined."""
    edges = random_graph(9, n=80, groups=80, inside=0.1)
    ids = np.unique([e[0] for e in edges])
    s, d, w = np.searchsorted(ids, [e[0] for e in edges]), np.searchsorted(ids, [e[1] for e in edges]), np.array([e[2] for e in edges])
    k, rate, c = np.bincount(s, weights=w), 1 / w.sum(), np.zeros(len(ids), dtype=int)
    r = leiden._refined(ids, s, d, w, k, c, rate, 1, "x")
    assert 1 < len(set(r.tolist())) < len(ids)
    for x in set(r.tolist()):
        own = r == x
        inside = w[own[s] & own[d]].sum()
        assert own.sum() == 1 or inside - rate * (k[own].sum() ** 2 - (k[own] ** 2).sum()) > 0  # better together than alone
        near = {i: set(d[(s == i) & own[d]].tolist()) for i in np.flatnonzero(own)}
        seen, stack = set(), [int(np.flatnonzero(own)[0])]
        while stack:
            i = stack.pop()
            seen.add(i)
            stack += near[i] - seen
        assert len(seen) == own.sum()


def test_joins_and_tasks_give_the_same(spark):
    edges = random_graph(1, n=40, groups=10)
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    inside = {r.gid: r.cluster for r in graph.leiden(df, passes=1).collect()}
    assert partition(inside) == partition(in_memory(edges, passes=1))
    joined = {r.gid: r.cluster for r in graph.leiden(df, passes=1, task_edges=len(edges) // 2).collect()}  # by joins first, the rest in a task
    assert joined == inside


def test_a_badly_connected_community_is_parted(spark):
    """Two cliques in one community, joined by one weak edge: it is connected, so cutting into parts would keep it, and no single node gains by leaving."""
    clique = lambda low: {(a, b): 1.0 for a in range(low, low + 6) for b in range(low, a)}
    edges = both_ways(clique(0) | clique(10) | {(10, 0): 0.1} | clique(20) | clique(30) | {(30, 20): 0.1})
    start = {v: v // 20 for v in {a for a, _, _ in edges}}
    ids = np.unique([e[0] for e in edges])
    s, d = np.searchsorted(ids, [e[0] for e in edges]), np.searchsorted(ids, [e[1] for e in edges])
    parts = leiden._split(ids, s, d, np.array([start[i] for i in ids.tolist()]))
    assert len(set(parts.tolist())) == 2
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    begin = spark.createDataFrame(sorted(start.items()), "gid long, cluster int")
    for most in (1_000_000, 0):
        found = {r.gid: r.cluster for r in graph.leiden(df, start=begin, passes=1, task_edges=most).collect()}
        assert partition(found) == {frozenset(range(low, low + 6)) for low in (0, 10, 20, 30)}


def test_graphs_without_edges_or_weight(spark):
    none = spark.createDataFrame([], "src long, dst long, w double")
    assert graph.leiden(none).count() == 0
    zero = spark.createDataFrame([(1, 2, 0.0), (2, 1, 0.0), (3, 3, 1.0)], "src long, dst long, w double")
    assert {r.gid for r in graph.leiden(zero).collect()} == {1, 2}


def shuffled_rows(spark, work):
    """What work returns, and the rows that its stages shuffled."""
    store = lambda: spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway

    def rows():
        stages = store().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.length())}

    before = rows()
    out = work()
    return out, sum(n for stage, n in rows().items() if stage not in before)


def test_rounds_by_joins_do_not_shuffle_the_graph(spark):
    """Complete groups of 120: edges are shuffled to their nodes once, the rounds shuffle sums."""
    edges = both_ways({(a, b): 1.0 for low in (0, 200) for a in range(low, low + 120) for b in range(low, a)} | {(200, 0): 0.01})
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    found, rows = shuffled_rows(spark, lambda: {r.gid: r.cluster for r in graph.leiden(df, passes=1, task_edges=1000).collect()})
    assert partition(found) == {frozenset(range(low, low + 120)) for low in (0, 200)}
    assert rows < 3 * len(edges)


def test_half_a_million_edges_stay_in_one_task(spark, monkeypatch):
    """The neighbour graph of 10,000 spots has about 400,000 edges; just above that it went through joins, minutes instead of seconds."""
    monkeypatch.setattr(leiden, "_in_task", lambda graph, nodes, fn: nodes.select("node", "c"))
    monkeypatch.setattr(leiden, "_moved_by_joins", lambda *a: pytest.fail("moved by joins"))
    half = spark.range(12_500).select("id", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("by")).select(F.col("id").alias("src"), ((F.col("id") + F.col("by")) % 12_500).alias("dst"), F.lit(1.0).alias("w"))
    edges = half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    assert graph.leiden(edges).count() == 12_500


def test_moving_is_the_rule_spelled_out():
    """Greatest gain, staying before going, then the lesser community; a node on its own gains nothing."""
    rnd = np.random.default_rng(5)
    for seed in range(20):
        n = 12
        a = np.triu(rnd.integers(0, 3, (n, n)) * (rnd.random((n, n)) < 0.4), 1).astype(float)
        a += a.T
        s, d = np.nonzero(a)
        w, k, c, rate = a[s, d], a.sum(1), np.zeros(n, dtype=int) + np.arange(n) % 3, 1.0 / max(a.sum(), 1)
        ids, want = np.arange(n), c
        for turn in range(leiden.TURNS):
            want = np.array([np.flatnonzero(want == x).min() for x in want])
            to = []
            for v in range(n):
                options = [(0.0, want[v] == v, -v)] if want[v] != v else []
                for x in {want[v], *want[np.flatnonzero(a[v])]}:
                    others = k[want == x].sum() - (k[v] if want[v] == x else 0)
                    options.append((round(a[v, want == x].sum() - rate * k[v] * others, 12), x == want[v], -x))
                to.append(-max(options)[2])
            to = np.array(to)
            if (to == want).all():
                break
            want = np.where((to != want) & leiden._coin(ids, *leiden._line(seed, 0, turn, "move"), leiden._share(turn)), to, want)
        want = np.array([np.flatnonzero(want == x).min() for x in want])
        assert (leiden._moved(ids, s, d, w, k, c, rate, 0, seed) == want).all()
