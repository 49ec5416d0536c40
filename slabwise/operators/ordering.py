"""The order of slices: distances between slices and the shortest path through them."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabwise.model import OrderConfig
from slabwise.session import cut, kept

from . import linalg, neighbors, transport


def _ranked(samples: DataFrame, k: int) -> DataFrame:
    """(i, j, u, v): v is one of the k nearest of u in slice j, for all other slices j."""
    keys = [r["slice_idx"] for r in samples.select("slice_idx").distinct().collect()]  # a row for each slice
    pairs = samples.sparkSession.createDataFrame([(i, j, f"{i}>{j}") for i in keys for j in keys if i != j], "i int, j int, part string")
    rows = samples.select(F.col("slice_idx").cast("int").alias("s"), "gid", "vec")
    of = lambda c: rows.join(F.broadcast(pairs.select(F.col(c).alias("s"), "part")), "s").select("part", "gid", "vec")
    return neighbors.vector_knn(of("i"), of("j"), k).join(F.broadcast(pairs), "part").select("i", "j", F.col("src").alias("u"), F.col("dst").alias("v"))


def mutual_similarity(samples: DataFrame, k: int = 30) -> DataFrame:
    """(i, j, mutual, similarity): mutual neighbours of slices i and j as a share of what slice i could have."""
    near = cut(_ranked(samples, k))
    sizes = F.broadcast(samples.groupBy("slice_idx").agg(F.count("*").alias("n")))  # a row for each slice
    back = near.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("u"), F.col("u").alias("v"))
    both = near.join(back, ["i", "j", "u", "v"]).groupBy("i", "j").agg(F.count("*").alias("mutual"))
    with_i = both.join(sizes.select(F.col("slice_idx").alias("i"), F.col("n").alias("ni")), "i").join(sizes.select(F.col("slice_idx").alias("j"), F.col("n").alias("nj")), "j")
    return with_i.select("i", "j", "mutual", (F.col("mutual") / (F.col("ni") * F.least(F.lit(k), "nj") + F.lit(1e-12))).alias("similarity"))


def ot_distances(samples: DataFrame, reg: float = 0.05, rounds: int = 2000, tol: float = 1e-9) -> DataFrame:
    """(i, j, distance) of slices i < j: the transport cost between bounded samples (slice_idx, gid, vec), a task for each pair."""
    keys = [r["slice_idx"] for r in samples.select("slice_idx").distinct().orderBy("slice_idx").collect()]
    spark = samples.sparkSession
    pairs = list(itertools.combinations(keys, 2))
    if not pairs:
        return spark.createDataFrame([], "i int, j int, distance double")
    table = spark.createDataFrame([(i, j, s) for i, j in pairs for s in (i, j)], "i int, j int, slice_idx int")

    def one(pdf):
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        a, b = (np.array(pdf[pdf["slice_idx"] == s].sort_values("gid")["vec"].tolist(), dtype=float) for s in (i, j))
        cost = transport.squared_distances(a, b)
        pi = transport.sinkhorn(np.full(len(a), 1 / len(a)), np.full(len(b), 1 / len(b)), cost, reg, None, rounds, tol)
        return pd.DataFrame([(i, j, float((pi * cost).sum()))], columns=["i", "j", "distance"])

    return samples.select("slice_idx", "gid", "vec").join(F.broadcast(table), "slice_idx").groupBy("i", "j").applyInPandas(one, "i int, j int, distance double")


#: Relative difference up to which two sums count as equal: those of the two directions may differ in their last bits.
EQUAL = 1e-12


def shortest_path(distances: DataFrame, canonical: bool = False) -> list[int]:
    """The shortest path through all nodes 0 to n - 1 of (i, j, d), exactly, by levels of grouped minima.

    A state is the set of nodes behind (bits of a long) and the last of them; a level joins the states of
    k nodes with the distances from their last ones and keeps the least cost of each new state, ties to the lesser node before. Each level
    is a table in the shared folder, its rows the back pointers: the driver reads one of each. Of both directions the path takes the
    one that ends at the lesser end; canonical: that starts there. A pair without a distance isn't walked. At most 62 nodes.
    """
    steps = distances.filter("i <> j").select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("d").cast("double").alias("d"))
    nodes = steps.select("i").union(steps.select("j")).distinct().count()
    if nodes <= 2:
        return list(range(nodes))
    if nodes > 62:
        raise ValueError("at most 62 nodes")
    steps = F.broadcast(cut(steps))  # n (n - 1) rows
    bit = lambda c: F.expr(f"shiftleft(1L, {c})")
    spark = distances.sparkSession
    level = spark.range(nodes).select(F.col("id").cast("int").alias("last")).select(bit("last").alias("mask"), "last", F.lit(0.0).alias("cost"), F.lit(-1).alias("before"))
    levels = [level]
    for _ in range(nodes - 1):
        longer = levels[-1].join(steps, F.col("last") == F.col("i")).filter(F.col("mask").bitwiseAND(bit("j")) == 0)
        best = longer.groupBy(F.col("mask").bitwiseOR(bit("j")).alias("mask"), F.col("j").alias("last"))
        least = best.agg(F.min(F.struct((F.col("cost") + F.col("d")).alias("cost"), F.col("last").alias("before"))).alias("s"))
        levels.append(kept(least.select("mask", "last", "s.cost", "s.before")))
    ends = sorted((r["last"], r["cost"], r["before"]) for r in levels[-1].collect())  # a row for each node
    if not ends:
        raise ValueError("no path meets all nodes")
    low = min(cost for _, cost, _ in ends)
    last, _, before = next(e for e in ends if e[1] <= low + EQUAL * max(1.0, abs(low)))
    path, mask = [last], (1 << nodes) - 1
    for level in levels[-2::-1]:
        mask, last = mask ^ (1 << last), before
        path.append(last)
        before = level.filter((F.col("mask") == mask) & (F.col("last") == last)).first()["before"]
    return path if canonical else path[::-1]


def held_karp(d: np.ndarray, canonical: bool = False) -> list[int]:
    """shortest_path of a small matrix, in memory."""
    n = len(d)
    if n <= 2:
        return list(range(n))
    best = np.full((1 << n, n), np.inf)
    before = np.full((1 << n, n), -1)
    for j in range(n):
        best[1 << j, j] = 0.0
    for mask in range(1, 1 << n):
        for j in range(n):
            if mask >> j & 1 and mask != 1 << j:
                costs = best[mask ^ (1 << j)] + d[:, j]
                k = int(np.argmin(costs))
                best[mask, j], before[mask, j] = costs[k], k
    ends = np.flatnonzero(best[-1] <= best[-1].min() + EQUAL * max(1.0, abs(best[-1].min())))
    j, mask, path = int(ends[0]), (1 << n) - 1, []
    while j >= 0:
        path.append(j)
        mask, j = mask ^ (1 << j), int(before[mask, j])
    return path if canonical else path[::-1]


def path_cost(d: np.ndarray, path: list[int]) -> float:
    return float(sum(d[a, b] for a, b in zip(path, path[1:])))


def infer_order(features: DataFrame, config: OrderConfig = OrderConfig()) -> list[int]:
    """The slices of (gid, slice_idx, vec) in the order of the shortest path through their distances."""
    keys = [r["slice_idx"] for r in features.select("slice_idx").distinct().orderBy("slice_idx").collect()]
    if len(keys) < 2:
        return keys
    samples = cut(neighbors.subsample(features.select("gid", "slice_idx", "vec"), config.subsample_n, config.random_state))
    samples = cut(linalg.svd_embedding(samples, config.svd_dim))
    at = samples.sparkSession.createDataFrame(list(enumerate(keys)), "place int, slice_idx int")  # a row for each slice
    place = lambda c: F.broadcast(at.select(F.col("slice_idx").alias(c), F.col("place").alias(f"p{c}")))
    if config.use_ot:
        half = cut(ot_distances(samples, config.ot_reg).select("i", "j", F.col("distance").alias("d")))
    else:
        pairs = samples.sparkSession.createDataFrame(list(itertools.combinations(keys, 2)), "i int, j int")
        near = mutual_similarity(samples, config.knn).select("i", "j", "similarity")  # of both directions the lesser slice's
        half = cut(pairs.join(near, ["i", "j"], "left").select("i", "j", (1 - F.coalesce("similarity", F.lit(0.0))).alias("d")))
    d = half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    path = shortest_path(d.join(place("i"), "i").join(place("j"), "j").select(F.col("pi").alias("i"), F.col("pj").alias("j"), "d"), config.canonical_direction)
    return [keys[i] for i in path]
