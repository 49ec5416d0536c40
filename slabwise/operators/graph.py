"""Neighbour graphs in three dimensions, degrees, and community detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabwise.session import cut

from . import leiden as communities
from . import neighbors
from .ranking import medians_of_made, numbered, quantiles


def gaussian(d2, sigma, alpha: float = 1.0, eps: float = 1e-12):
    """alpha * exp(-d^2 / sigma^2), sigma^2 at least eps."""
    return F.lit(float(alpha)) * F.exp(-d2 / F.greatest(sigma * sigma, F.lit(eps)))


def median_distance(edges: DataFrame, by: list[str]) -> DataFrame:
    """The exact median of the distances, by group: (by, sigma)."""
    return quantiles(edges.select(*by, F.sqrt("d2").alias("d")), by, "d", [0.5]).select(*by, F.col("quantile").alias("sigma"))


def symmetrised(directed: DataFrame) -> DataFrame:
    """W + W^T with equal edges added up; zero weights go. A mutual pair thus weighs both directions."""
    both = directed.select("src", "dst", "w").unionByName(directed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w")).filter("w <> 0")


def binarised(directed: DataFrame) -> DataFrame:
    """Each edge in both directions, once, with weight 1."""
    both = directed.select("src", "dst").union(directed.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.distinct().withColumn("w", F.lit(1.0))


def adjacency(
    spots: DataFrame,
    n_intra: int = 15,
    n_inter: int = 5,
    radius_intra: float | None = None,
    radius_inter: float | None = None,
    mapping: DataFrame | None = None,
    prefer_mapping: bool = True,
    lambda_z: float = 0.01,
    z_spacing: float = 1.0,
) -> DataFrame:
    """Binary graph: within slices, and between neighbouring ones by the mapping where a pair has one, else by geometry."""
    intra = neighbors.radius_within(spots, radius_intra) if radius_intra is not None else neighbors.knn_within(spots, n_intra)
    inter = neighbors.radius_across(spots, radius_inter, lambda_z, z_spacing) if radius_inter is not None else neighbors.knn_across(spots, n_inter, lambda_z, z_spacing)
    parts = intra.select("src", "dst")
    if mapping is not None and prefer_mapping:
        used = mapping.filter(F.col("rank") <= n_inter)
        pairs = used.select("slice_hi").distinct()
        high = F.when(F.col("forward"), F.col("src_slice") + 1).otherwise(F.col("src_slice")) if "forward" in inter.columns else F.col("src_slice") + 1
        inter = inter.withColumn("slice_hi", high).join(F.broadcast(pairs), "slice_hi", "left_anti")
        parts = parts.unionByName(used.select(F.col("gid_hi").alias("src"), F.col("gid_lo").alias("dst")))
    return binarised(parts.unionByName(inter.select("src", "dst")).filter("src <> dst"))


def weighted_graph(
    spots: DataFrame,
    n_intra: int = 15,
    n_inter: int = 5,
    radius_intra: float | None = None,
    radius_inter: float | None = None,
    mapping: DataFrame | None = None,
    alpha_intra: float = 1.0,
    beta_map: float = 2.0,
    gamma_inter: float = 1.0,
    sigma_intra: float | None = None,
    sigma_inter: float | None = None,
    lambda_z: float = 0.01,
    z_spacing: float = 1.0,
    eps: float = 1e-12,
) -> DataFrame:
    """Weighted graph (src, dst, w): Gaussian edges within slices and between neighbouring ones, plus beta_map for each mapped pair.

    The bandwidth is the median distance of a slice's edges, and of a pair's forward
    edges, which the backward ones share. Edges to itself are never made. A graph by radii
    alone, of ids that stand once, is made without writing or shuffling an edge.
    """
    if radius_intra is not None and radius_inter is not None and mapping is None and not spots.groupBy("gid").count().filter("count > 1").limit(1).count():
        return _radius_graph(spots, radius_intra, radius_inter, alpha_intra, gamma_inter, sigma_intra, sigma_inter, lambda_z, z_spacing, eps)
    intra = (neighbors.radius_within(spots, radius_intra) if radius_intra is not None else neighbors.knn_within(spots, n_intra)).select("slice_idx", "src", "dst", "d2")
    intra = cut(intra)
    sigma = median_distance(intra, ["slice_idx"]) if sigma_intra is None else intra.select("slice_idx").distinct().withColumn("sigma", F.lit(float(sigma_intra)))
    parts = intra.join(F.broadcast(sigma), "slice_idx").select("src", "dst", gaussian(F.col("d2"), F.col("sigma"), alpha_intra, eps).alias("w"))
    inter = neighbors.radius_across(spots, radius_inter, lambda_z, z_spacing) if radius_inter is not None else neighbors.knn_across(spots, n_inter, lambda_z, z_spacing)
    if "forward" not in inter.columns:
        inter = inter.withColumn("forward", F.lit(True))
    inter = cut(inter.withColumn("low", F.when(F.col("forward"), F.col("src_slice")).otherwise(F.col("src_slice") - 1)))
    across = median_distance(inter.filter("forward"), ["low"]) if sigma_inter is None else inter.select("low").distinct().withColumn("sigma", F.lit(float(sigma_inter)))
    parts = parts.unionByName(inter.join(F.broadcast(across), "low").select("src", "dst", gaussian(F.col("d2"), F.col("sigma"), gamma_inter, eps).alias("w")))
    if mapping is not None:
        parts = parts.unionByName(mapping.filter(F.col("rank") <= n_inter).select(F.col("gid_hi").alias("src"), F.col("gid_lo").alias("dst"), F.lit(float(beta_map)).alias("w")))
    return symmetrised(parts.filter("src <> dst"))


def _radius_graph(spots, radius_intra, radius_inter, alpha, gamma, sigma_intra, sigma_inter, lambda_z, z_spacing, eps) -> DataFrame:
    """weighted_graph by radii: its edges grow with the square of the spots, so they are made again for each pass, from cells, where they are used.

    A pair within a slice is mutual and weighs twice; one between slices is made forward only. As ids stand once, no pair comes twice and nothing is added up.
    """
    points = cut(spots.select("gid", "slice_idx", "x", "y"))
    intra = neighbors.radius_pairs(points, radius_intra)
    inter = neighbors.radius_across(points, radius_inter, lambda_z, z_spacing).withColumnRenamed("src_slice", "slice_idx")
    ways = F.explode(F.array(*(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("src", "dst"), ("dst", "src")))))

    def weighed(pairs, radius, times, weight, sigma):
        if sigma is None:
            # the pairs of a slice, each once, have the median of their edges; a row for each slice
            middle = medians_of_made(pairs.select("slice_idx", F.sqrt("d2").alias("d")), "slice_idx", "d", radius)
            pairs = pairs.join(F.broadcast(cut(middle.withColumnRenamed("quantile", "sigma"))), "slice_idx")
        else:
            pairs = pairs.withColumn("sigma", F.lit(float(sigma)))
        w = F.lit(times) * gaussian(F.col("d2"), F.col("sigma"), weight, eps)
        return pairs.select("src", "dst", w.alias("w")).filter("w <> 0").select(ways.alias("way"), "w").select("way.src", "way.dst", "w")

    return weighed(intra, radius_intra, 2.0, alpha, sigma_intra).unionByName(weighed(inter, radius_inter, 1.0, gamma, sigma_inter))


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sum("w").alias("degree"))


def row_normalised(edges: DataFrame, eps: float = 1e-12) -> DataFrame:
    """w / (degree + eps)."""
    return edges.join(degree(edges), "src").select("src", "dst", (F.col("w") / (F.col("degree") + F.lit(eps))).alias("w"))


def leiden(
    edges: DataFrame,
    resolution: float = 1.0,
    seed: int = 0,
    levels: int = 10,
    passes: int = 10,
    start: DataFrame | None = None,
    task_edges: int = communities.EDGES_OF_A_TASK,
) -> DataFrame:
    """Communities (gid, cluster) of a symmetric weighted graph by modularity, resolution as in the RB configuration model.

    Local moving, refinement to well-connected communities, and coarsening, repeated from
    what was found until nothing changes; each community is connected. Graphs of more than
    task_edges edges go through joins and grouped sums, level by level, until one task can
    finish them; the rule is one for both. start (gid, cluster) may say where to begin. Clusters
    are numbered by falling size, then least member.
    """
    member = communities.communities(edges, resolution, seed, levels, passes, start, task_edges)
    sizes = member.groupBy("c").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    numbers = numbered(sizes.withColumn("less", -F.col("n")), ["less", "least"], "cluster").select("c", F.col("cluster").cast("int").alias("cluster"))
    return member.join(numbers, "c").select(F.col("node").alias("gid"), "cluster")


def modularity(edges: DataFrame, clusters: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (q): the RB quality of a clustering (gid, cluster), as a share of the total weight."""
    total = edges.agg(F.sum("w").alias("m2"))
    labelled = edges.join(clusters.select(F.col("gid").alias("src"), F.col("cluster").alias("cs")), "src").join(clusters.select(F.col("gid").alias("dst"), F.col("cluster").alias("cd")), "dst")
    inside = labelled.agg(F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("inside"))
    mass = labelled.groupBy("cs").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    one = lambda df: df.withColumn("_", F.lit(0))  # noqa: E731  single rows, joined by a constant
    row = one(total).join(one(inside), "_").join(one(mass), "_")
    return row.select((F.col("inside") / F.col("m2") - F.lit(resolution) * F.col("k2") / (F.col("m2") * F.col("m2"))).alias("q"))
