"""Spatially variable features: quality filters, the projection test, and multiple testing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slabwise.session import cut, shuffle_width

from .ranking import quantiles

MT_PREFIXES = ("mt-", "MT-")


def spot_totals(spots: DataFrame, counts: DataFrame) -> DataFrame:
    """(gid, total) of every spot, 0 where it has no counts."""
    sums = counts.groupBy("gid").agg(F.sum("value").alias("total"))
    return spots.select("gid").join(sums, "gid", "left").select("gid", F.coalesce("total", F.lit(0.0)).alias("total"))


def filter_spots(spots: DataFrame, counts: DataFrame, least: float = 1) -> DataFrame:
    return spot_totals(spots, counts).filter(F.col("total") >= least).select("gid")


def gene_totals(counts: DataFrame) -> DataFrame:
    """(gene_idx, gene, total, nonzero)."""
    return counts.groupBy("gene_idx").agg(F.first("gene").alias("gene"), F.sum("value").alias("total"), F.count_if(F.col("value") > 0).alias("nonzero"))


def without_prefixes(genes: DataFrame, prefixes: tuple[str, ...] = MT_PREFIXES) -> DataFrame:
    bad = F.lit(False)
    for p in prefixes:
        bad = bad | F.col("gene").startswith(p)
    return genes.filter(~bad)


def filter_genes(counts: DataFrame, least_spots: int = 5, least_total: float = 10, exclude: tuple[str, ...] = MT_PREFIXES, most: int | None = None) -> DataFrame:
    """Genes that pass, from counts of the spots that passed before; of more than `most` those of greatest total, ties to the lesser index."""
    return _passing(gene_totals(counts), least_spots, least_total, exclude, most)


def _passing(totals: DataFrame, least_spots: int, least_total: float, exclude: tuple[str, ...], most: int | None) -> DataFrame:
    genes = without_prefixes(totals.filter((F.col("nonzero") >= least_spots) & (F.col("total") >= least_total)), exclude)
    return genes.orderBy(F.desc("total"), "gene_idx").limit(most) if most is not None else genes


def presence(kept: DataFrame, least: int = 2) -> DataFrame:
    """Genes kept in at least so many slices, of (slice_idx, gene): (gene, slices)."""
    return kept.groupBy("gene").agg(F.count_distinct("slice_idx").alias("slices")).filter(F.col("slices") >= least)


def kernels(spots: DataFrame) -> tuple[int, list[Column]]:
    """The number of spots, and eleven pairs of transformed, centred coordinates as expressions of x and y: they are made where they are summed up, and never written.

    The coordinates themselves; Gaussian exp(-c^2 / 2 l^2) and cosine cos(2 pi c / l) of each,
    l being the 20, 40, 60, 80 and 100 % quantiles of its absolute value. spots has been written, as it is read several times.
    """
    middle = spots.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my")).first()
    if not middle["n"]:
        return 0, [F.lit(0.0)] * 22
    at = {c: F.col(c) - F.lit(middle[f"m{c}"]) for c in ("x", "y")}
    shares = [0.2, 0.4, 0.6, 0.8, 1.0]
    both = spots.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.abs(at[c]).alias("a")) for c in ("x", "y")))).alias("e")).select("e.c", "e.a")
    row: dict[str, list[float]] = {"x": [], "y": []}
    for r in quantiles(both, ["c"], "a", shares, written=True).orderBy("share").collect():
        row[r["c"]].append(r["quantile"])
    s: list[Column] = [at["x"], at["y"]]
    for make in (lambda c, q: F.exp(-c * c / (2 * q * q)), lambda c, q: F.cos(2 * math.pi * c / q)):
        for i in range(len(shares)):
            s += [make(at[c], max(row[c][i], 1e-12)) for c in ("x", "y")]
    means = spots.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(s))).first()
    return middle["n"], [c - F.lit(float(means[f"m{i}"])) for i, c in enumerate(s)]


def projection_test(spots: DataFrame, counts: DataFrame) -> DataFrame:
    """(gene_idx, gene, p1..p11, combined): association of each gene with each pair of coordinates.

    n R^2 of the regression of centred counts on the two coordinates is chi-squared with
    two degrees of freedom when the gene ignores them: p = exp(-n R^2 / 2). Needed of a
    gene are its sums of y, y^2, y s1 and y s2 over non-zeros alone. The p-values are
    combined by the Cauchy rule. A gene without variance has p = 1.

    Counts go to their gene with the spot's two coordinates: partial sums of the
    22 transformed ones would be wider than the few counts of a gene that a task holds.
    """
    return _projected(cut(spots.select("gid", "x", "y")), counts).drop("total", "nonzero")


def _projected(placed: DataFrame, counts: DataFrame) -> DataFrame:
    """projection_test of spots (gid, x, y) that have been written, with each gene's total and number of non-zeros."""
    n, s = kernels(placed)
    pairs = 11
    held = placed.select(*(c.alias(f"s{i}") for i, c in enumerate(s)))
    e = lambda i: F.col(f"s{i}")
    moments = held.agg(*(F.sum(e(2 * k + a) * e(2 * k + b)).alias(f"m{k}{a}{b}") for k in range(pairs) for a, b in ((0, 0), (0, 1), (1, 1)))).first()
    moments = {k: v or 0.0 for k, v in moments.asDict().items()}
    met = counts.select("gid", "gene_idx", "gene", "value").join(placed, "gid").select("gene_idx", "gene", "value", "x", "y").repartition("gene_idx")
    sums = met.groupBy("gene_idx").agg(
        F.first("gene").alias("gene"), F.count_if(F.col("value") > 0).alias("nonzero"), F.sum("value").alias("y"), F.sum(F.col("value") * F.col("value")).alias("yy"), *(F.sum(F.col("value") * c).alias(f"c{i}") for i, c in enumerate(s))
    )
    spread = F.col("yy") - F.col("y") * F.col("y") / F.lit(float(n))
    ps = []
    for k in range(pairs):
        a, b, d = moments[f"m{k}00"], moments[f"m{k}01"], moments[f"m{k}11"]
        det = a * d - b * b
        u, v = F.col(f"c{2 * k}"), F.col(f"c{2 * k + 1}")
        if det > 1e-12 * max(a * d, 1e-300):
            explained = (d * u * u - 2 * b * u * v + a * v * v) / det
        else:
            explained = u * u / max(a, 1e-300)
        ps.append(F.when(spread > 1e-12, F.exp(-float(n) / 2 * F.least(explained / spread, F.lit(1.0)))).otherwise(1.0).alias(f"p{k + 1}"))
    tested = sums.select("gene_idx", "gene", F.col("y").alias("total"), "nonzero", *ps)
    return tested.withColumn("combined", cauchy([F.col(f"p{k + 1}") for k in range(pairs)]))


def cauchy(ps: list[Column]) -> Column:
    """Cauchy combination of p-values, kept within (1e-300, 1 - 1e-9)."""
    term = lambda p: F.tan((0.5 - F.greatest(F.lit(1e-15), F.least(p, F.lit(1 - 1e-9)))) * math.pi)
    mean = sum((term(p) for p in ps), F.lit(0.0)) / len(ps)
    return F.greatest(F.lit(0.0), 0.5 - F.atan(mean) / math.pi)


def bh_adjust(tests: DataFrame, p: str = "p", key: str = "gene") -> DataFrame:
    """tests with `adjusted`: Benjamini-Hochberg, min over greater p of p m / rank, at most 1.

    Ranks and the running minimum are over all tests. The tests are first ordered into
    ranges; counts and minima of whole ranges are combined, so no window spans the table.
    """
    rows = cut(tests.filter(F.col(p).isNotNull()).repartitionByRange(shuffle_width(tests.sparkSession), p, key).withColumn("__r", F.spark_partition_id()))
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__r").orderBy(p, key)))
    sizes = ranked.groupBy("__r").agg(F.count("*").alias("size"))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    m = rows.count()
    valued = cut(ranked.join(F.broadcast(starts), "__r").withColumn("__v", F.col(p) * F.lit(float(m)) / (F.col("start") + F.col("__n"))))
    least = valued.groupBy("__r").agg(F.min("__v").alias("low"))
    after = Window.orderBy("__r").rowsBetween(1, Window.unboundedFollowing)
    later = least.withColumn("later", F.min("low").over(after)).select("__r", "later")
    down = Window.partitionBy("__r").orderBy(F.desc(p), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    joined = valued.withColumn("__w", F.min("__v").over(down)).join(F.broadcast(later), "__r", "left")
    return joined.select(*tests.columns, F.least(F.lit(1.0), "__w", "later").alias("adjusted"))


def top_genes(tests: DataFrame, n: int = 1000, sort_by: str = "adjusted", fallback: str = "combined", key: str = "gene") -> DataFrame:
    """The n tests of least p; sorted by `fallback` where `sort_by` is no column."""
    by = sort_by if sort_by in tests.columns else fallback
    if by not in tests.columns:
        raise ValueError(f"no column {sort_by} or {fallback}")
    return tests.orderBy(F.asc_nulls_last(by), key).limit(n)


def spatially_variable(
    spots: DataFrame,
    counts: DataFrame,
    exclude: tuple[str, ...] = MT_PREFIXES,
    min_spot_total_counts: float = 1,
    min_gene_nonzero_spots: int = 5,
    min_gene_total_counts: float = 10,
    max_genes: int | None = None,
) -> DataFrame:
    """Filter spots, then genes on what is left, test them, adjust: (gene_idx, gene, p1..p11, combined, adjusted)."""
    kept = filter_spots(spots, counts, min_spot_total_counts)
    mine = cut(spots.select("gid", "x", "y").join(kept, "gid", "left_semi"))
    # the sums of the test hold what the filter asks, so counts are met once
    tested = _passing(_projected(mine, counts), min_gene_nonzero_spots, min_gene_total_counts, exclude, max_genes)
    return bh_adjust(tested.drop("total", "nonzero"), "combined")


def looks_integer(counts: DataFrame, first: int = 100) -> DataFrame:
    """One row (is_integer): whether the first non-zeros, by spot and gene, are whole numbers."""
    return counts.filter("value <> 0").orderBy("gid", "gene_idx").limit(first).agg(F.bool_and(F.col("value") % 1 == 0).alias("is_integer"))
