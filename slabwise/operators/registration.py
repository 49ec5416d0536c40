"""Registration of slices: poses as grouped aggregates, and the alignment drivers."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabwise.functions.blocks import rows_of
from slabwise.model import AlignResult, Cube, Later
from slabwise.session import cut, kept

from . import linalg, neighbors, points, posegraph, transport


# ---- poses ---------------------------------------------------------------------------------------
def procrustes(pairs: DataFrame, by: list[str], similarity: bool = False, scale_min: float = 0.5, scale_max: float = 2.0) -> DataFrame:
    """Weighted least-squares pose of each group of correspondences (sx, sy) -> (tx, ty), weight w: (by, theta, s, dx, dy).

    One grouped pass over moments: theta = atan2(C01 - C10, C00 + C11) of the centred
    covariance C, which is the SVD solution with its reflection fix. With similarity,
    the scale is the sum of C's singular values over the source's variance, clipped;
    1 if the source has none.
    """
    m = lambda e: F.sum(F.col("w") * e)
    sx, sy, tx, ty = (F.col(c) for c in ("sx", "sy", "tx", "ty"))
    sums = pairs.groupBy(*by).agg(
        F.sum("w").alias("W"), m(sx).alias("sx"), m(sy).alias("sy"), m(tx).alias("tx"), m(ty).alias("ty"),
        m(sx * tx).alias("xx"), m(sx * ty).alias("xy"), m(sy * tx).alias("yx"), m(sy * ty).alias("yy"), m(sx * sx + sy * sy).alias("ss"),
    )
    W = F.col("W")
    c = {"c00": F.col("xx") - sx * tx / W, "c01": F.col("xy") - sx * ty / W, "c10": F.col("yx") - sy * tx / W, "c11": F.col("yy") - sy * ty / W, "var": F.col("ss") - (sx * sx + sy * sy) / W}
    fit = sums.withColumns(c).withColumn("theta", F.atan2(F.col("c01") - F.col("c10"), F.col("c00") + F.col("c11")))
    s = F.lit(1.0)
    if similarity:
        square = sum((F.col(k) * F.col(k) for k in ("c00", "c01", "c10", "c11")), F.lit(0.0))
        singular = F.sqrt(square + 2 * F.abs(F.col("c00") * F.col("c11") - F.col("c01") * F.col("c10")))
        s = F.when(F.col("var") > 1e-12, F.greatest(F.lit(scale_min), F.least(F.lit(scale_max), singular / F.col("var")))).otherwise(1.0)
    fit = fit.withColumn("s", s)
    x, y, cos, sin = sx / W, sy / W, F.cos("theta"), F.sin("theta")
    return fit.select(*by, "theta", "s", (tx / W - F.col("s") * (cos * x - sin * y)).alias("dx"), (ty / W - F.col("s") * (sin * x + cos * y)).alias("dy"))


def apply_poses(spots: DataFrame, poses: DataFrame, x: str = "x_raw", y: str = "y_raw") -> DataFrame:
    """spots with x and y = s R (x_raw, y_raw) + t of their slice's pose; slices without a pose stay."""
    p = F.broadcast(poses.select("slice_idx", "theta", "s", "dx", "dy"))  # a row for each slice
    own = lambda a, b: F.coalesce(a, b)
    cos, sin = F.cos("theta"), F.sin("theta")
    out = spots.join(p, "slice_idx", "left").withColumns(
        {"__x": own(F.col("s") * (cos * F.col(x) - sin * F.col(y)) + F.col("dx"), F.col(x)), "__y": own(F.col("s") * (sin * F.col(x) + cos * F.col(y)) + F.col("dy"), F.col(y))}
    )
    return out.withColumns({"x": F.col("__x"), "y": F.col("__y")}).drop("theta", "s", "dx", "dy", "__x", "__y")


def rotation(theta: float) -> np.ndarray:
    return np.array([[math.cos(theta), -math.sin(theta)], [math.sin(theta), math.cos(theta)]])


def fit_pose(src: np.ndarray, tgt: np.ndarray, w: np.ndarray, similarity: bool = False, bounds: tuple[float, float] = (0.98, 1.02)) -> tuple[float, np.ndarray, np.ndarray]:
    """(s, R, t) of the same closed form, for a bounded block in memory."""
    w = w / max(w.sum(), 1e-300)
    ms, mt = w @ src, w @ tgt
    c = ((src - ms) * w[:, None]).T @ (tgt - mt)
    r = rotation(math.atan2(c[0, 1] - c[1, 0], c[0, 0] + c[1, 1]))
    s = 1.0
    if similarity:
        var = float(w @ ((src - ms) ** 2).sum(1))
        if var > 1e-12:
            s = float(np.clip(math.sqrt((c**2).sum() + 2 * abs(np.linalg.det(c))) / var, *bounds))
    return s, r, mt - s * (r @ ms)


def alignment_pairs(n: int, strategy: str = "sequential", anchor: int | None = None) -> list[tuple[int, int]]:
    """(source, target) in the order in which they are registered."""
    if strategy == "sequential":
        return [(i + 1, i) for i in range(n - 1)]
    if strategy != "middle_out":
        raise ValueError("strategy must be 'sequential' or 'middle_out'")
    a = (n - 1) // 2 if anchor is None else min(max(anchor, 0), n - 1)
    down = [(i, i + 1) for i in range(a - 1, -1, -1)]
    up = [(i + 1, i) for i in range(a, n - 1)]
    return down + up


def chamfer_of(a: np.ndarray, b: np.ndarray) -> float:
    """Mean squared distance to the nearest point of the other set, both ways, of bounded blocks; NaN if a side is empty."""
    if a.shape[1] != b.shape[1]:
        raise ValueError("both sets need the same dimension")
    if not len(a) or not len(b):
        return float("nan")
    total, back = 0.0, np.full(len(b), np.inf)
    if a.shape[1] == 2 and len(a) * len(b) > transport.ENTRIES:
        return float(points.nearest_in_plane(a, b, 1).mean() + points.nearest_in_plane(b, a, 1).mean())
    for low, high in transport.row_blocks(len(a), len(b)):
        d = transport.squared_distances(a[low:high], b)
        total, back = total + d.min(1).sum(), np.minimum(back, d.min(0))
    return float(total / len(a) + back.mean())


# ---- blocks --------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Options:
    """Parameters of the alignment drivers. Without subsample_n all spots of a slice are taken, without emd_max_n any number of them may be assigned exactly."""

    subsample_n: int | None = 2000
    paired_subsample: bool = True
    svd_dim: int = 50
    feature_mode: str = "svd_smooth"
    smooth_k: int = 15
    smooth_alpha: float = 0.7
    smooth_steps: int = 2
    expr_knn: int | None = 50
    transport: str = "emd"
    emd_max_n: int | None = 2000
    ot_reg: float = 0.05
    ot_num_iter_max: int = 20_000
    ot_stop_thr: float = 1e-9
    clip_quantile: float | None = None
    n_iter: int = 3
    allow_scale: bool = False
    scale_min: float = 0.98
    scale_max: float = 1.02
    spatial_weight: float = 0.2
    unbalanced_reg_m: float | None = 10.0
    random_state: int = 0


@dataclass
class Block:
    """A bounded sample of a slice, or a whole one: ids, positions and features, in the order of the ids."""

    gid: np.ndarray
    xy: np.ndarray
    vec: np.ndarray


#: Spots of a target up to which the gate's scale is their own spacing; beyond, it is what the spacing of so many would be.
GATE_SPOTS = 2000


def target_spacing(xy: np.ndarray, k: int = 10) -> float:
    """The median distance of a point to its k nearest, itself included."""
    k = min(k, len(xy))
    if len(xy) ** 2 > transport.ENTRIES:
        return float(max(np.median(np.sqrt(points.nearest_in_plane(xy, xy, k))), 1e-6))
    d = [np.partition(transport.squared_distances(xy[low:high], xy), k - 1, axis=1)[:, :k] for low, high in transport.row_blocks(len(xy), len(xy))]
    return float(max(np.median(np.sqrt(np.concatenate(d))), 1e-6))


def register(src: Block, tgt: Block, o: Options) -> tuple[float, np.ndarray, np.ndarray, float, str]:
    """Register a source block to a target block: (s, R, t, chamfer, method).

    The feature cost is gated by the distance of the moving source to the target, so
    each round's plan depends on the pose before.
    """
    exact = o.transport in transport.ASSIGNMENT and len(src.gid) == len(tgt.gid) and (o.emd_max_n is None or len(src.gid) <= o.emd_max_n)
    if exact and points.serves(src.vec, tgt.vec, o.expr_knn, o.clip_quantile):
        cost = points.Points(src.vec, tgt.vec).tie_broken()
    else:
        cost = transport.Costs.of(src.vec, tgt.vec, o.expr_knn).cleaned(o.clip_quantile)
        cost = cost.tie_broken() if exact else cost
    # closer spots of a whole slice don't make the gate outweigh the features
    sigma = target_spacing(tgt.xy) * math.sqrt(max(1.0, len(tgt.gid) / GATE_SPOTS))
    s, r, t = 1.0, np.eye(2), np.zeros(2)
    now, method = src.xy, o.transport
    for _ in range(o.n_iter):
        w, mean, method = transport.barycentric_move(cost.gated(now, tgt.xy, sigma, o.spatial_weight), tgt.xy, o.transport, o.ot_reg, o.emd_max_n, o.unbalanced_reg_m, o.ot_num_iter_max, o.ot_stop_thr)
        ds, dr, dt = fit_pose(now, mean, w, o.allow_scale, (o.scale_min, o.scale_max))
        s, r, t = ds * s, dr @ r, ds * (dr @ t) + dt
        now = s * src.xy @ r.T + t
    name = f"coarse_{method}_{'similarity' if o.allow_scale else 'rigid'}" + "_spatial" * bool(o.spatial_weight) + "_unbalanced" * (method == "sinkhorn" and o.unbalanced_reg_m is not None)
    return s, r, t, chamfer_of(now, tgt.xy), name


def matched(src: Block, tgt: Block, o: Options) -> tuple[Block, Block]:
    """The blocks to register: of sides of different sizes, the target's spots that are nearest to one of the source, if they are at least half of what may be taken."""
    if o.paired_subsample and len(src.gid) != len(tgt.gid):
        near = np.unique(transport.nearest(src.vec, tgt.vec))
        if len(near) >= min(len(tgt.gid), o.subsample_n or len(tgt.gid)) / 2:
            tgt = Block(tgt.gid[near], tgt.xy[near], tgt.vec[near])
    return src, tgt


def moved_block(block: Block, pose: tuple | None) -> Block:
    if pose is None:
        return block
    s, r, t = pose
    return replace(block, xy=s * block.xy @ r.T + t)


def _registered_in_task(rows: DataFrame, source: int, target: int, pose: tuple | None, o: Options) -> tuple[float, np.ndarray, np.ndarray, float, str]:
    """register of two whole slices of rows (gid, slice_idx, x, y, vec) in one task, the target under its pose."""
    names = ("s", "r00", "r01", "r10", "r11", "t0", "t1", "chamfer")

    def run(batches):
        held = [b for b in batches if b.num_rows]
        gid, of, x, y = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("gid", "slice_idx", "x", "y"))
        vec = np.concatenate([rows_of(b.column("vec")) for b in held])
        del held
        sides = []
        for k in (source, target):
            own = np.flatnonzero(of == k)
            own = own[np.argsort(gid[own], kind="stable")]
            sides.append(Block(gid[own], np.stack([x[own], y[own]], axis=1), vec[own]))
        del vec
        s, r, t, far, name = register(*matched(sides[0], moved_block(sides[1], pose), o), o)
        found = {n: [float(v)] for n, v in zip(names, (s, *r.ravel(), *t, far))}
        yield pa.RecordBatch.from_pydict({**found, "method": [name]})

    picked = rows.filter(F.col("slice_idx").isin(source, target)).select("gid", "slice_idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("vec").cast("array<double>").alias("vec"))
    got = picked.repartition(1).mapInArrow(run, ", ".join(f"{n} double" for n in names) + ", method string").first()
    return got["s"], np.array([[got["r00"], got["r01"]], [got["r10"], got["r11"]]]), np.array([got["t0"], got["t1"]]), got["chamfer"], got["method"]


def shared_embedding(cube: Cube, o: Options) -> DataFrame:
    if o.feature_mode not in ("svd", "svd_smooth"):
        raise ValueError("feature_mode must be 'svd' or 'svd_smooth'")
    e = linalg.svd_embedding(cube.embedding, o.svd_dim, o.subsample_n, o.random_state)
    return linalg.smooth(e, cube.spots, o.smooth_k, o.smooth_alpha, o.smooth_steps) if o.feature_mode == "svd_smooth" else e


def sampled(cube: Cube, embedding: DataFrame, o: Options) -> DataFrame:
    """(gid, slice_idx, x, y, vec) of at most subsample_n spots of each slice, of all without it."""
    return neighbors.subsample(cube.spots.select("gid", "slice_idx", "x", "y"), o.subsample_n, o.random_state).join(embedding.select("gid", "vec"), "gid")


def sampled_blocks(cube: Cube, embedding: DataFrame, o: Options) -> dict[int, Block]:
    """The slices' samples on the driver: at most subsample_n rows for each of a few slices."""
    return {int(k): block_of(g) for k, g in sampled(cube, embedding, o).toPandas().groupby("slice_idx")}


def block_of(pdf) -> Block:
    pdf = pdf.sort_values("gid")
    return Block(pdf["gid"].to_numpy(), pdf[["x", "y"]].to_numpy(float), np.array(pdf["vec"].tolist(), dtype=float))


def by_neighbours(rows: DataFrame, fn, schema: str, keys: list[int] | None = None) -> DataFrame:
    """fn(pair, low, high) for every slice and the next, a task for each pair: rows (gid, slice_idx, x, y, vec) are bounded samples, pair the lower slice's place."""
    if keys is None:
        keys = [r["slice_idx"] for r in rows.select("slice_idx").distinct().orderBy("slice_idx").collect()]
    names = [f.split()[0] for f in schema.split(", ")]
    table = [(p, side, keys[p + side]) for p in range(len(keys) - 1) for side in (0, 1)]
    pairs = F.broadcast(rows.sparkSession.createDataFrame(table, "pair int, side int, slice_idx int"))  # two rows for each slice

    def one(pdf):
        import pandas as pd

        low, high = (block_of(pdf[pdf["side"] == s]) for s in (0, 1))
        return pd.DataFrame(fn(int(pdf["pair"].iloc[0]), low, high), columns=names)

    return rows.select("gid", "slice_idx", "x", "y", "vec").join(pairs, "slice_idx").groupBy("pair").applyInPandas(one, schema)


def _pose_rows(poses: dict[int, tuple]) -> list[tuple]:
    return [(k, math.atan2(r[1, 0], r[0, 0]), float(s), float(t[0]), float(t[1])) for k, (s, r, t) in sorted(poses.items())]


def _poses(cube: Cube, poses: dict[int, tuple]) -> DataFrame:
    return cube.spots.sparkSession.createDataFrame(_pose_rows(poses), "slice_idx int, theta double, s double, dx double, dy double")


def _moved(cube: Cube, poses: dict[int, tuple]) -> Cube:
    return replace(cube, spots=apply_poses(cube.spots, _poses(cube, poses), "x", "y"))


def mapping_to_previous(embedding: DataFrame, k: int = 5) -> DataFrame:
    """map_to_prev: the k nearest spots of the slice before, by features."""
    high = embedding.select(F.col("gid").alias("src"), F.col("slice_idx").alias("slice_hi"))
    return neighbors.feature_knn(embedding, k, step=-1).join(high, "src").select(F.col("src").alias("gid_hi"), F.col("dst").alias("gid_lo"), "slice_hi", "d2", "rank")


# ---- drivers -------------------------------------------------------------------------------------
def align_adjacent(cube: Cube, options: Options = Options(), strategy: str = "sequential", anchor: int | None = None) -> tuple[Cube, list[AlignResult], DataFrame]:
    """Register each slice to its neighbour that was registered before: (cube, results, poses).

    A pair's target has moved already, so pairs are a fold: on the driver over bounded samples, or
    without subsample_n over all spots, a task for a pair, one after the other; features, full-size
    moves and the mapping are distributed.
    """
    embedding = cut(shared_embedding(cube, options))
    sizes = {r["slice_idx"]: r["n"] for r in cube.spots.groupBy("slice_idx").agg(F.count("*").alias("n")).collect()}
    if options.subsample_n is None:
        rows = kept(sampled(cube, embedding, options), "slice_idx")
        fit = lambda source, target, pose: _registered_in_task(rows, source, target, pose, options)
        keys = sorted(r["slice_idx"] for r in rows.select("slice_idx").distinct().collect())
    else:
        blocks = sampled_blocks(cube, embedding, options)
        fit = lambda source, target, pose: register(*matched(blocks[source], moved_block(blocks[target], pose), options), options)
        keys = sorted(blocks)
    poses, results = {}, []
    for i, j in alignment_pairs(len(keys), strategy, anchor):
        s, r, t, far, name = fit(keys[i], keys[j], poses.get(keys[j]))
        poses[keys[i]] = (s, r, t)
        results.append(AlignResult(far, sizes[keys[i]], sizes[keys[j]], name))
    moved = replace(_moved(cube, poses), mapping=Later(lambda: mapping_to_previous(embedding)))
    return moved, results, _poses(cube, poses)


def align_to_anchor(cube: Cube, options: Options = Options(), anchor: int | None = None, refresh_mapping: bool = True) -> tuple[Cube, DataFrame]:
    """Register every slice straight to the anchor, all at once, a task for each slice: (cube, poses with chamfer and method)."""
    embedding = cut(shared_embedding(cube, options))
    keys = [r["slice_idx"] for r in cube.spots.select("slice_idx").distinct().orderBy("slice_idx").collect()]
    if anchor is None:
        anchor = keys[(len(keys) - 1) // 2]
    if anchor not in keys:
        raise ValueError("anchor out of range")
    picked = neighbors.subsample(cube.spots.select("gid", "slice_idx", "x", "y"), options.subsample_n, options.random_state).join(embedding.select("gid", "vec"), "gid")
    target = picked.filter(F.col("slice_idx") == anchor).toPandas().sort_values("gid")
    shared = cube.spots.sparkSession.sparkContext.broadcast(Block(target["gid"].to_numpy(), target[["x", "y"]].to_numpy(float), np.array(target["vec"].tolist(), dtype=float)))

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("gid")
        src = Block(pdf["gid"].to_numpy(), pdf[["x", "y"]].to_numpy(float), np.array(pdf["vec"].tolist(), dtype=float))
        s, r, t, far, name = register(src, shared.value, options)
        row = _pose_rows({int(pdf["slice_idx"].iloc[0]): (s, r, t)})[0]
        return pd.DataFrame([(*row, far, name)], columns=["slice_idx", "theta", "s", "dx", "dy", "chamfer", "method"])

    poses = cut(picked.filter(F.col("slice_idx") != anchor).groupBy("slice_idx").applyInPandas(one, "slice_idx int, theta double, s double, dx double, dy double, chamfer double, method string"))
    moved = replace(cube, spots=apply_poses(cube.spots, poses, "x", "y"), mapping=Later(lambda: mapping_to_previous(embedding)) if refresh_mapping else cube.mapping)
    return moved, poses


def align_global(cube: Cube, options: Options = Options(), anchor: int = 0, lam_smooth: float = 0.0, max_nfev: int = 50) -> tuple[Cube, dict]:
    """Pose graph over neighbouring slices: correspondences are found once, then all poses are solved together.

    Every pair enters through its moments alone (posegraph.py), eleven numbers from a grouped sum.
    Without smoothing the graph is a chain and the optimum is each pair's own fit, composed
    outward from the anchor; with it, damped Gauss-Newton steps start from there, each a
    block-tridiagonal solve. Returns (cube, {status, success, cost, nfev, poses}).
    """
    keys = [r["slice_idx"] for r in cube.spots.select("slice_idx").distinct().orderBy("slice_idx").collect()]
    if len(keys) < 2:
        return cube, {"status": "skipped", "success": True, "cost": 0.0, "nfev": 0, "poses": {}}
    if not 0 <= anchor < len(keys):
        raise ValueError("anchor out of range")
    embedding = linalg.svd_embedding(cube.embedding, options.svd_dim, options.subsample_n, options.random_state)

    def correspond(pair, low, high):
        try:
            cost = transport.Costs.of(high.vec, low.vec, options.expr_knn).cleaned(options.clip_quantile, pairwise=False)
        except RuntimeError:
            return []
        w, mean, _ = transport.barycentric_move(cost, low.xy, options.transport, options.ot_reg, options.emd_max_n, None, options.ot_num_iter_max, options.ot_stop_thr)
        return [(pair, *map(float, (*p, *q, x))) for p, q, x in zip(high.xy, mean, w) if x > 0]

    found = by_neighbours(sampled(cube, embedding, options), correspond, "pair int, px double, py double, qx double, qy double, w double", keys)
    found = cut(found)  # plans are solved once, their moments take two passes
    links = {r["pair"]: posegraph.Moments.of(r) for r in posegraph.moments(found, ["pair"]).collect()}  # a row for each pair of slices
    if not links:
        return cube, {"status": "failed", "success": False, "cost": float("nan"), "nfev": 0, "poses": {}}
    x, cost, nfev = posegraph.solve(links, len(keys), anchor, lam_smooth, max_nfev)
    poses = {keys[i]: (1.0, rotation(x[i, 0]), x[i, 1:]) for i in range(len(keys)) if i != anchor}
    report = {"status": "ok", "success": True, "cost": cost, "nfev": nfev, "poses": {k: (math.atan2(r[1, 0], r[0, 0]), *t) for k, (_, r, t) in poses.items()}}
    return _moved(cube, poses), report


def align_roundtrip(cube: Cube, options: Options = Options(n_iter=2), roundtrip_steps: int = 5, compat: bool = False) -> tuple[Cube, DataFrame]:
    """Adjacent alignment by features that are exchanged back and forth: (cube, poses).

    Plans depend on features alone, so all pairs have theirs at once; poses then follow
    one from the other. By default similar rows cost little, barycentres are divided by row mass and the
    steps' poses are composed; compat takes the similarity's negative, leaves barycentres
    undivided and applies the last step's pose only.
    """
    keys = [r["slice_idx"] for r in cube.spots.select("slice_idx").distinct().orderBy("slice_idx").collect()]
    embedding = linalg.svd_embedding(cube.embedding, options.svd_dim, options.subsample_n, options.random_state)
    sign = -1.0 if compat else 1.0

    def exchange(pair, tgt, src):
        """The plan by features alone, as each source spot's mass and its weighted sum of target places."""
        a, b = np.full(len(src.gid), 1 / len(src.gid)), np.full(len(tgt.gid), 1 / len(tgt.gid))
        hs, ht, pi = src.vec, tgt.vec, None
        for _ in range(roundtrip_steps):
            logits = sign * (hs @ ht.T) / math.sqrt(hs.shape[1])
            soft = np.exp(logits - logits.max(1, keepdims=True))
            cost = -np.log(soft / (soft.sum(1, keepdims=True) + 1e-12) + 1e-12)
            pi = transport.sinkhorn(a, b, cost, options.ot_reg, None, options.ot_num_iter_max, options.ot_stop_thr)
            hs = pi @ ht if compat else transport.barycentres(pi, ht)[1]
            ht = pi.T @ hs if compat else transport.barycentres(pi.T, hs)[1]
        return [(pair, *map(float, (*p, x, *q))) for p, x, q in zip(src.xy, pi.sum(axis=1), pi @ tgt.xy)]

    found = by_neighbours(sampled(cube, embedding, options), exchange, "pair int, px double, py double, w double, sx double, sy double", keys).toPandas()
    poses = {}
    before = (np.eye(2), np.zeros(2))  # the target's pose: it has moved already
    for i, g in sorted(found.groupby("pair")):
        now, w = g[["px", "py"]].to_numpy(), g["w"].to_numpy()
        placed = g[["sx", "sy"]].to_numpy() @ before[0].T + w[:, None] * before[1]
        mean = placed if compat else placed / (w + 1e-12)[:, None]
        r, t = np.eye(2), np.zeros(2)
        for _ in range(options.n_iter):
            _, dr, dt = fit_pose(now, mean, w)
            r, t = (dr, dt) if compat else (dr @ r, dr @ t + dt)
            now = now @ dr.T + dt
        poses[keys[int(i) + 1]] = (1.0, r, t)
        before = (r, t)
    return _moved(cube, poses), _poses(cube, poses)
