"""A contrastive embedding on a graph: a small perceptron trained so that neighbours agree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slabwise.functions.blocks import rows_of
from slabwise.model import ContrastiveConfig
from slabwise.session import cut, kept

#: Epochs whose batches are drawn and written with one job; the driver holds none of them.
EPOCHS = 16
#: Anchors whose logits against a whole batch are held at a time.
ANCHORS = 512


def positives(nodes: DataFrame, edges: DataFrame, seed: int = 0) -> DataFrame:
    """(gid, positive): one neighbour of each node, whichever md5 puts first, weights ignored; the node itself if it has none."""
    first = Window.partitionBy("src").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("src").cast("string"), F.col("dst").cast("string"))), "dst")
    one = edges.withColumn("n", F.row_number().over(first)).filter("n = 1").select(F.col("src").alias("gid"), F.col("dst").alias("positive"))
    return nodes.select("gid").join(one, "gid", "left").select("gid", F.coalesce("positive", "gid").alias("positive"))


def forward(x: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    h = x @ w["a"] + w["b"]
    r = np.maximum(h, 0)
    o = r @ w["c"] + w["d"]
    n = np.sqrt((o**2).sum(1, keepdims=True)) + 1e-12
    return h, r, o, n, o / n


def loss_and_gradient(x: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray], temperature: float) -> tuple[float, dict[str, np.ndarray]]:
    """InfoNCE of anchors x against their positives y, the other positives being negatives."""
    fx, fy = forward(x, w), forward(y, w)
    loss, n = 0.0, len(x)
    dx, dy = np.zeros_like(fx[4]), np.zeros_like(fy[4])
    for low in range(0, n, ANCHORS):
        z = fx[4][low : low + ANCHORS]
        p = z @ fy[4].T / temperature
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        own = (np.arange(len(z)), np.arange(low, low + len(z)))
        loss -= float(np.log(np.maximum(p[own], 1e-300)).sum())
        p[own] -= 1.0
        p /= n * temperature
        dx[low : low + ANCHORS] = p @ fy[4]
        dy += p.T @ z
    out = {k: np.zeros_like(v) for k, v in w.items()}
    for (h, r, o, norm, z), inp, dz in ((fx, x, dx), (fy, y, dy)):
        do = (dz - z * (dz * z).sum(1, keepdims=True)) / norm
        dh = (do @ w["c"].T) * (h > 0)
        out["c"] += r.T @ do
        out["d"] += do.sum(0)
        out["a"] += inp.T @ dh
        out["b"] += dh.sum(0)
    return loss / max(1, n), out


class Weights:
    """The perceptron's weights and the moments of their gradients: two small matrices and two vectors of each."""

    def __init__(self, d: int, c: ContrastiveConfig):
        rng = np.random.default_rng(c.random_state)
        self.c, self.t = c, 0
        self.w = {
            "a": rng.normal(0, np.sqrt(2 / d), (d, c.hidden_dim)), "b": np.zeros(c.hidden_dim),
            "c": rng.normal(0, np.sqrt(1 / c.hidden_dim), (c.hidden_dim, c.embed_dim)), "d": np.zeros(c.embed_dim),
        }
        self.m, self.v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        c, self.t = self.c, self.t + 1
        for k in self.w:
            self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
            self.v[k] = 0.999 * self.v[k] + 0.001 * g[k] ** 2
            self.w[k] = self.w[k] * (1 - c.lr * c.weight_decay) - c.lr * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def train(batches: list[tuple[np.ndarray, np.ndarray]], c: ContrastiveConfig) -> tuple[dict[str, np.ndarray], list[float]]:
    """Training in one process on batches in memory, a step for each."""
    weights, losses = Weights(batches[0][0].shape[1], c), []
    for x, y in batches:
        loss, g = loss_and_gradient(x, y, weights.w, c.temperature)
        losses.append(loss)
        weights.step(g)
    return weights.w, losses


def drawn(x: DataFrame, edges: DataFrame, config: ContrastiveConfig, n: int, epochs: range) -> DataFrame:
    """(epoch, batch, rows): config.parallel batches for each epoch, of at most batch_size nodes each, with their positives.

    A node's place in an epoch comes from a hash; rows is an array of (gid, vec, pvec)
    in the order of gid. n is the number of nodes. Batches are disjoint.
    """
    seed, wanted = F.lit(config.random_state), config.batch_size * config.parallel
    share = min(1.0, (1.2 * wanted + 100) / max(1, n))
    rank = F.xxhash64("gid", seed, F.col("epoch"))
    turns = F.explode(F.sequence(F.lit(epochs.start), F.lit(epochs.stop - 1)))
    ids = x.select("gid", turns.alias("epoch")).filter(F.pmod(rank, F.lit(1_000_000)) < int(np.ceil(share * 1_000_000)))
    # a bounded number of ids for each epoch
    place = F.row_number().over(Window.partitionBy("epoch").orderBy(rank, "gid"))
    ids = cut(ids.withColumn("n", place).filter(F.col("n") <= wanted).select("epoch", "gid", ((F.col("n") - 1) % config.parallel).alias("batch")))
    key = F.md5(F.concat_ws(":", (seed + F.col("epoch")).cast("string"), F.col("gid").cast("string"), F.col("dst").cast("string")))
    near = ids.join(edges.select(F.col("src").alias("gid"), "dst"), "gid")
    first = near.groupBy("epoch", "gid").agg(F.min(F.struct(key.alias("k"), "dst")).alias("p")).select("epoch", "gid", F.col("p.dst").alias("positive"))
    both = ids.join(first, ["epoch", "gid"], "left").withColumn("positive", F.coalesce("positive", "gid")).join(x.select("gid", "vec"), "gid")
    both = both.join(x.select(F.col("gid").alias("positive"), F.col("vec").alias("pvec")), "positive")
    return both.groupBy("epoch", "batch").agg(F.sort_array(F.collect_list(F.struct("gid", "vec", "pvec"))).alias("rows"))


def gradient_of(batches: DataFrame, weights: dict[str, np.ndarray], config: ContrastiveConfig) -> tuple[float, dict[str, np.ndarray]]:
    """(loss, gradient), the mean over batches (batch, rows): each task adds up its batches' and sends one flat sum."""
    shared = batches.sparkSession.sparkContext.broadcast(weights)

    def one(it):
        loss, n, total = 0.0, 0, None
        for arrow in it:
            for rows in arrow.column("rows"):
                x, y = (rows_of(rows.values.field(c)) for c in ("vec", "pvec"))
                one_loss, g = loss_and_gradient(x, y, shared.value, config.temperature)
                flat = np.concatenate([g[k].ravel() for k in sorted(g)])
                total = flat if total is None else total + flat
                loss, n = loss + one_loss, n + 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.float64()))], names=["loss", "n", "g"])

    sums = batches.select("rows").mapInArrow(one, "loss double, n long, g array<double>").collect()  # a row for each task
    shared.destroy()
    n = sum(r["n"] for r in sums)
    flat, out = np.sum([r["g"] for r in sorted(sums)], axis=0) / n, {}
    for k in sorted(weights):
        out[k], flat = flat[: weights[k].size].reshape(weights[k].shape), flat[weights[k].size :]
    return sum(r["loss"] for r in sums) / n, out


def fit(x: DataFrame, edges: DataFrame, config: ContrastiveConfig = ContrastiveConfig()) -> tuple[dict[str, np.ndarray] | None, list[float]]:
    """(weights, losses) of training on (gid, vec) and its graph, the gradient of each epoch summed from tasks.

    Batches are written to the shared folder for EPOCHS epochs at a time and an epoch
    reads its own; only weights and sums of gradients meet the driver. Without rows there are no weights.
    """
    size = x.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    if not size["n"]:
        return None, []
    weights, losses = Weights(size["d"], config), []
    for low in range(0, config.epochs, EPOCHS):
        epochs = range(low, min(low + EPOCHS, config.epochs))
        batches = kept(drawn(x, edges, config, size["n"], epochs), "epoch")
        for e in epochs:
            own = batches.filter(F.col("epoch") == e)
            loss, g = gradient_of(own if config.parallel == 1 else own.repartition(config.parallel, "batch"), weights.w, config)
            losses.append(loss)
            weights.step(g)
    return weights.w, losses


def embed(features: DataFrame, edges: DataFrame, config: ContrastiveConfig = ContrastiveConfig()) -> tuple[DataFrame, list[float]]:
    """((gid, vec of unit length), losses): train on bounded batches of nodes and their positives in each epoch, apply to all."""
    x = cut(features.select("gid", F.col("vec").cast("array<double>").alias("vec")))
    w, losses = fit(x, edges, config)
    if w is None:
        return x.select("gid", F.col("vec").cast("array<float>").alias("vec")), losses
    shared = features.sparkSession.sparkContext.broadcast(w)  # two small matrices

    def apply(it):
        for batch in it:
            z = forward(np.array(batch.column("vec").to_pylist(), dtype=float), shared.value)[4] if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("gid"), pa.array(z.astype(np.float32).tolist(), pa.list_(pa.float32()))], names=["gid", "vec"])

    return x.mapInArrow(apply, "gid long, vec array<float>"), losses
