"""Graph-regularised Gaussian mixtures and the clustering of a cube into domains."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabwise.functions.arrays import argmax, total
from slabwise.functions.blocks import rows_of
from slabwise.model import Cube
from slabwise.session import cut

from . import blocked, graph, linalg


def statistics(rows: DataFrame, k: int, dim: int) -> dict[str, np.ndarray]:
    """Sums of q, q x and q x^2 over rows (vec, q), by cluster and dimension: each task adds its rows up and hands on k rows for each dimension."""

    def add(batches):
        total = np.zeros((k, 1 + 2 * dim))
        n = 0
        for batch in batches:
            if batch.num_rows:
                x, q = rows_of(batch.column("vec")), rows_of(batch.column("q"))
                total += np.column_stack([q.sum(axis=0), q.T @ x, q.T @ (x * x)])
                n += len(x)
        cluster, place = np.divmod(np.arange(total.size), total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(cluster, k), pa.int32()), pa.array(np.append(place, 0), pa.int32()), pa.array(np.append(total.ravel(), float(n)))], names=["c", "j", "v"])

    out = np.zeros((k, 1 + 2 * dim))
    n = 0.0
    for r in rows.select("vec", "q").mapInArrow(add, "c int, j int, v double").groupBy("c", "j").agg(F.sum("v").alias("v")).collect():
        if r["c"] == k:
            n = r["v"]
        else:
            out[r["c"], r["j"]] = r["v"]
    return {"n": n, "q": out[:, 0], "x": out[:, 1 : 1 + dim], "y": out[:, 1 + dim :]}


def maximise(s: dict[str, np.ndarray], cov_eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares, means and variances of the M-step."""
    nk = s["q"] + 1e-12
    mean = s["x"] / nk[:, None]
    var = np.maximum(s["y"] / nk[:, None] - 2 * mean * s["x"] / nk[:, None] + mean**2 * (s["q"] / nk)[:, None], 0.0) + cov_eps
    return nk / s["n"], mean, var


def log_density(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Log densities of rows under diagonal Gaussians, a column for each."""
    far = np.stack([((x - m) ** 2 / v).sum(axis=1) for m, v in zip(mean, var)], axis=1)
    return -0.5 * (np.log(2 * np.pi * var).sum(axis=1) + far)


def scores(rows: DataFrame, share, mean, var, lam: float, cov_eps: float) -> DataFrame:
    """E-step: (gid, vec, q) of rows (gid, vec, message), message being the neighbours' mean q or null; parameters are broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast((np.log(share), np.asarray(mean), np.maximum(var, cov_eps)))

    def step(batches):
        log_share, mean, var = shared.value
        k = len(log_share)
        for batch in batches:
            n = batch.num_rows
            x = rows_of(batch.column("vec")) if n else np.zeros((0, mean.shape[1]))
            logits = log_share + log_density(x, mean, var)
            logits += lam * np.array([m or [0.0] * k for m in batch.column("message").to_pylist()]).reshape(n, k)
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            q = e / (e.sum(axis=1, keepdims=True) + 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column("gid"), batch.column("vec"), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(q.ravel()))], names=["gid", "vec", "q"])

    return rows.select("gid", "vec", "message").mapInArrow(step, "gid long, vec array<double>, q array<double>")


def gmm(
    features: DataFrame,
    edges: DataFrame,
    n_clusters: int,
    lam: float = 1.0,
    n_iter: int = 30,
    init: str = "kmeans",
    seed: int = 0,
    cov_eps: float = 1e-4,
    init_labels: DataFrame | None = None,
    places: DataFrame | None = None,
) -> tuple[DataFrame, np.ndarray, int]:
    """Mean-field EM of a diagonal mixture whose responsibilities follow their graph neighbours: ((gid, cluster, q), means, rounds).

    Each round: q from densities, shares and lam times the neighbours' weighted mean of
    the q before; then shares, means and variances. It ends when no label changes.
    """
    if n_clusters <= 1:
        raise ValueError("n_clusters must be more than 1")
    x = cut(features.select("gid", F.col("vec").cast("array<double>").alias("vec")))
    n = x.count()
    if n < n_clusters:
        raise ValueError("there are fewer rows than clusters")
    dim = x.select(F.size("vec").alias("d")).first()["d"]
    if init_labels is not None:
        q = x.join(init_labels.select("gid", F.col("cluster").alias("c")), "gid")
    elif init == "kmeans":
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        fitted = KMeans(k=n_clusters, seed=seed, featuresCol="f", predictionCol="c")
        with_f = x.withColumn("f", array_to_vector("vec"))
        q = fitted.fit(with_f).transform(with_f).select("gid", "vec", "c")
    elif init == "random":
        u = [(F.pmod(F.xxhash64("gid", F.lit(seed), F.lit(c)), F.lit(1_000_003)) + 1).cast("double") for c in range(n_clusters)]
        q = x.withColumn("u", F.array(*u)).select("gid", "vec", F.transform("u", lambda v: v / total("u")).alias("q"))
    else:
        raise ValueError("init must be 'kmeans' or 'random'")
    if "q" not in q.columns:
        soft = [F.when(F.col("c") == i, 0.95).otherwise(0.0) + F.lit(0.05 / n_clusters) for i in range(n_clusters)]
        q = q.select("gid", "vec", F.array(*soft).alias("q"))
    q = cut(q)
    a = cut(graph.row_normalised(edges))
    matrix = blocked.BlockedMatrix(a, linalg.places_of(a, x) if places is None else places)
    share, mean, var = maximise(statistics(q, n_clusters, dim), cov_eps)
    labels = None
    for turn in range(1, n_iter + 1):
        message = matrix.product(q.select("gid", F.col("q").alias("vec"))).withColumnRenamed("vec", "message")
        stepped = scores(q.select("gid", "vec").join(message, "gid", "left"), share, mean, var, lam, cov_eps).select("gid", "vec", "q", argmax("q").alias("cluster"))
        q = cut(stepped)
        share, mean, var = maximise(statistics(q, n_clusters, dim), cov_eps)
        if labels is not None and not q.join(labels.select("gid", F.col("cluster").alias("was")), "gid").filter("cluster <> was").limit(1).count():
            break
        labels = q.select("gid", "cluster")
    return q.select("gid", "cluster", "q"), mean, turn


def cluster_cube(
    cube: Cube,
    n_clusters: int = 20,
    svd_dim: int = 50,
    n_intra: int = 15,
    n_inter: int = 5,
    alpha_intra: float = 1.0,
    beta_map: float = 2.0,
    gamma_inter: float = 1.0,
    eta: float = 0.5,
    diffusion_steps: int = 50,
    diffusion_tol: float = 1e-6,
    lam: float = 1.0,
    em_iters: int = 30,
    init: str = "kmeans",
    seed: int = 0,
) -> tuple[Cube, DataFrame]:
    """Embed, build the weighted graph, diffuse, and fit the mixture: (cube with clusters, (gid, cluster, q))."""
    embedding = cut(linalg.svd_embedding(cube.embedding, svd_dim))
    edges = cut(
        graph.weighted_graph(
            cube.spots, n_intra, n_inter, mapping=cube.mapping, alpha_intra=alpha_intra, beta_map=beta_map, gamma_inter=gamma_inter, lambda_z=cube.lambda_z, z_spacing=cube.z_spacing
        )
    )
    places = cut(blocked.places_of_spots(cube.spots))
    z = linalg.diffuse(edges, embedding, eta, diffusion_steps, diffusion_tol, places=places)
    found, _, _ = gmm(z, edges, n_clusters, lam, em_iters, init, seed, places=places)
    return replace(cube, spots=cube.spots.drop("cluster").join(found.select("gid", "cluster"), "gid")), found
