"""Scores of a clustering."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabwise.functions.blocks import rows_of
from slabwise.session import cut, shuffle_width

#: Rows of a block whose distances to another block one task sums up; where rows need more than SIDES of them, blocks grow up to MOST.
BLOCK, SIDES, MOST = 2048, 12, 16_384

#: A squared distance below this share of both squared lengths is summed from its differences: the product has lost digits there.
CLOSE = 1e-4


def _one(df: DataFrame) -> DataFrame:
    return df.withColumn("_", F.lit(0))


def contingency(labels: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    return labels.groupBy(true, pred).agg(F.count("*").alias("n"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(labels: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """One row (ari)."""
    t = contingency(labels, true, pred)
    cells = t.agg(F.sum(_pairs(F.col("n"))).alias("a"), F.sum("n").alias("n"))
    rows = t.groupBy(true).agg(F.sum("n").alias("k")).agg(F.sum(_pairs(F.col("k"))).alias("r"))
    cols = t.groupBy(pred).agg(F.sum("n").alias("k")).agg(F.sum(_pairs(F.col("k"))).alias("c"))
    all_ = _one(cells).join(_one(rows), "_").join(_one(cols), "_")
    expected = F.col("r") * F.col("c") / _pairs(F.col("n"))
    top = (F.col("r") + F.col("c")) / 2
    return all_.select(F.when(top == expected, 1.0).otherwise((F.col("a") - expected) / (top - expected)).alias("ari"))


def normalised_mutual_information(labels: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """One row (nmi): mutual information over the mean of both entropies."""
    t = contingency(labels, true, pred)
    total = labels.agg(F.count("*").alias("total"))
    rows = t.groupBy(true).agg(F.sum("n").alias("rn"))
    cols = t.groupBy(pred).agg(F.sum("n").alias("cn"))
    p = F.col("n") / F.col("total")
    mi = _one(t.join(rows, true).join(cols, pred)).join(_one(total), "_").agg(F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("rn") * F.col("cn")))).alias("mi"))
    entropy = lambda df, c, name: _one(df).join(_one(total), "_").agg(F.sum(-(F.col(c) / F.col("total")) * F.log(F.col(c) / F.col("total"))).alias(name))
    all_ = _one(mi).join(_one(entropy(rows, "rn", "hr")), "_").join(_one(entropy(cols, "cn", "hc")), "_")
    mean = (F.col("hr") + F.col("hc")) / 2
    return all_.select(F.when(mean == 0, 1.0).otherwise(F.col("mi") / mean).alias("nmi"))


def macro_f1(labels: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """One row (f1): for each true label the best F1 over predicted ones, averaged by size."""
    t = contingency(labels, true, pred)
    rows = t.groupBy(true).agg(F.sum("n").alias("rn"))
    cols = t.groupBy(pred).agg(F.sum("n").alias("cn"))
    best = t.join(rows, true).join(cols, pred).groupBy(true).agg(F.max(2 * F.col("n") / (F.col("rn") + F.col("cn"))).alias("f"), F.first("rn").alias("rn"))
    return best.agg((F.sum(F.col("f") * F.col("rn")) / F.sum("rn")).alias("f1"))


def mapping_consistency(mapping: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row (consistency): the share of mapped pairs in one cluster."""
    hi = clusters.select(F.col("gid").alias("gid_hi"), F.col("cluster").alias("a"))
    lo = clusters.select(F.col("gid").alias("gid_lo"), F.col("cluster").alias("b"))
    return mapping.join(hi, "gid_hi").join(lo, "gid_lo").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("consistency"))


def sides(n: int) -> int:
    """Blocks that n rows are dealt into, which is how often each row is sent."""
    return max(1, math.ceil(n / MOST), min(SIDES, math.ceil(n / BLOCK)))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by a matrix product, those of close rows from their differences."""
    p, q = (a**2).sum(1)[:, None], (b**2).sum(1)[None, :]
    d = p + q - 2 * a @ b.T
    i, j = np.nonzero(~(d > CLOSE * (p + q)))
    for s in range(0, len(i), 65_536):
        own = slice(s, s + 65_536)
        d[i[own], j[own]] = ((a[i[own]] - b[j[own]]) ** 2).sum(1)
    return np.sqrt(d, out=d)


def silhouette(rows: DataFrame, label: str = "label", vec: str = "vec") -> DataFrame:
    """One row (silhouette) of (gid, label, vec): Euclidean, exact. NaN for fewer than 3 rows or 2 labels.

    Every row meets every block of rows in some task, which hands on one sum of distances for
    a row, a block and a label; pairs are never rows.
    """
    width = shuffle_width(rows.sparkSession)
    held = cut(rows.select("gid", F.col(label).cast("string").alias("label"), F.col(vec).cast("array<double>").alias("vec")))
    counts = held.groupBy("label").agg(F.count("*").alias("n"))
    n, k = (lambda r: (r["n"] or 0, r["k"]))(counts.agg(F.sum("n").alias("n"), F.count("*").alias("k")).first())
    side = sides(n)
    block = F.pmod(F.xxhash64("gid"), F.lit(side)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    a = held.withColumn("a", block).withColumn("b", every).withColumn("side", F.lit(0))
    b = held.withColumn("b", block).withColumn("a", every).withColumn("side", F.lit(1))

    def far(table):
        side, labels = np.array(table.column("side")), np.array(table.column("label").to_pylist(), dtype=object)
        x, gid = rows_of(table.column("vec").combine_chunks()), table.column("gid").to_numpy()
        s, t = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        names, code = np.unique(labels[t].astype(str), return_inverse=True)
        member = np.zeros((len(t), len(names)))
        member[np.arange(len(t)), code] = 1
        sums = np.zeros((len(s), len(names)))
        targets = x[t]
        for low in range(0, len(s), 64):
            sums[low : low + 64] = distances(x[s[low : low + 64]], targets) @ member
        at, to = np.indices(sums.shape)
        return pa.table({"gid": gid[s][at.ravel()], "own": pa.array(labels[s][at.ravel()], pa.string()), "other": pa.array(names[to.ravel()], pa.string()), "d": sums.ravel()})

    kind = rows.schema["gid"].dataType.simpleString()
    met = a.unionByName(b).repartition(width, "a", "b").groupBy("a", "b").applyInArrow(far, f"gid {kind}, own string, other string, d double")
    sums = met.groupBy("gid", "own", "other").agg(F.sum("d").alias("d")).join(F.broadcast(counts.select(F.col("label").alias("other"), "n")), "other")  # a row for each label
    same = F.col("own") == F.col("other")
    each = sums.groupBy("gid", "own").agg(F.max(F.when(same & (F.col("n") > 1), F.col("d") / (F.col("n") - 1))).alias("a"), F.min(F.when(~same, F.col("d") / F.col("n"))).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.agg(F.avg(s).alias("s")).select(F.lit(float("nan")).alias("silhouette") if n < 3 or k < 2 else F.col("s").alias("silhouette"))
