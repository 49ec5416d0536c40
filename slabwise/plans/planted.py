"""Queries with a known outcome: solvers on planted data, whose answers DuckDB can state."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from slabwise.model import ContrastiveConfig, Cube, OrderConfig
from slabwise.operators import contrastive, graph, linalg, mixture, ordering, registration, transport
from slabwise.sources import fixtures
from slabwise.sources.fixtures import sql

from .algebra import cube_of
from .catalog import query
from .graphs import graph_of

_R = lambda c, a=None, n=4: F.round(c, n).alias(a or c)

# ---- alignment: four copies of all spots, each turned by 0.3 more and moved by (2, -2) more ----------
COPIES, TURN, MOVE = 4, 0.3, (2.0, -2.0)
_OPTIONS = registration.Options(svd_dim=16, feature_mode="svd", expr_knn=None, n_iter=3)


def turned_copies(spark, sf_dir):
    i, far = F.col("slice_idx"), F.lit(10_000_000)
    turn = F.lit(TURN) * i
    rows = fixtures.spots(spark, sf_dir).select("gid", "x", "y", "vec").withColumn("slice_idx", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    # features far apart beside the distances of spots, so that every copy is its original's best match
    rows = rows.select(
        (F.col("gid") + far * i).alias("gid"), "slice_idx", F.concat(F.lit("S"), i.cast("string")).alias("slice_id"), F.transform("vec", lambda v: v * 30.0).alias("vec"),
        (F.cos(turn) * F.col("x") - F.sin(turn) * F.col("y") + MOVE[0] * i).alias("x"), (F.sin(turn) * F.col("x") + F.cos(turn) * F.col("y") + MOVE[1] * i).alias("y"),
    )
    return Cube(rows.select("gid", "slice_idx", "slice_id", "x", "y"), embedding=rows.select("gid", "slice_idx", "vec"))


def _pose_sql(frame: int, digits: int = 4) -> str:
    """The pose that takes copy i to copy `frame`: theta = 0.3 (frame - i), t = t_frame - R(theta) t_i."""
    return f"""select i as slice_idx, round(a, {digits}) as theta, round({MOVE[0] * frame} - (cos(a) * {MOVE[0]} * i - sin(a) * {MOVE[1]} * i), {digits}) as dx,
  round({MOVE[1] * frame} - (sin(a) * {MOVE[0]} * i + cos(a) * {MOVE[1]} * i), {digits}) as dy from (select cast(i as int) as i, cast({TURN} * ({frame} - i) as double) as a from range({COPIES}) t(i) where i <> {frame})"""


def _of(poses, digits=4):
    return poses.select("slice_idx", *(_R(c, n=digits) for c in ("theta", "dx", "dy")))


@query("planted_adjacent", _pose_sql(0))
def planted_adjacent(spark, sf_dir):
    """All spots of every copy are assigned."""
    return _of(registration.align_adjacent(turned_copies(spark, sf_dir), replace(_OPTIONS, subsample_n=None, emd_max_n=None))[2])


@query("planted_anchor", _pose_sql(1))
def planted_anchor(spark, sf_dir):
    return _of(registration.align_to_anchor(turned_copies(spark, sf_dir), _OPTIONS, anchor=1)[1])


@query("planted_global", _pose_sql(0))
def planted_global(spark, sf_dir):
    report = registration.align_global(turned_copies(spark, sf_dir), _OPTIONS)[1]
    return _of(spark.createDataFrame([(k, *map(float, v)) for k, v in report["poses"].items()], "slice_idx int, theta double, dx double, dy double"))


@query("planted_smooth", f"""select j as slice_idx, theta, dx, dy from (select cast(j as int) as j from range(1, {COPIES}) t(j)), ({_pose_sql(0)}) p where p.slice_idx = 1""")
def planted_smooth(spark, sf_dir):
    """A smoothness prior beyond all data: slices other than the anchor share one pose, the one that fits the slice beside the anchor, the only pair that it moves."""
    report = registration.align_global(turned_copies(spark, sf_dir), _OPTIONS, lam_smooth=1e9)[1]
    return _of(spark.createDataFrame([(k, *map(float, v)) for k, v in report["poses"].items()], "slice_idx int, theta double, dx double, dy double"))


@query("planted_roundtrip", _pose_sql(0, 2))
def planted_roundtrip(spark, sf_dir):
    """Entropic plans blur a little: errors stay below a hundredth."""
    return _of(registration.align_roundtrip(turned_copies(spark, sf_dir), registration.Options(svd_dim=16, n_iter=2, ot_num_iter_max=100))[1], 2)


@query("planted_mapping", sql("spots", then=f"select gid + 10000000 * i as gid_hi, gid + 10000000 * (i - 1) as gid_lo from spots, range(1, {COPIES}) t(i)"))
def planted_mapping(spark, sf_dir):
    """The mapping that alignment refreshes: every copy's nearest spot of the slice before is the copy there."""
    moved = registration.align_adjacent(turned_copies(spark, sf_dir), _OPTIONS)[0]
    return moved.mapping.filter("rank = 1").select("gid_hi", "gid_lo")


# ---- assignment, order, communities, mixtures ------------------------------------------------------
@query("planted_assignment", sql("spots", then="select gid as src, 10000000 - gid as dst from spots"))
def planted_assignment(spark, sf_dir):
    """Each slice against its own spots under other ids, in another order."""
    s = fixtures.spots(spark, sf_dir).select(F.col("slice_idx").alias("pair"), "gid", "vec")
    sides = s.withColumn("side", F.lit(0)).unionByName(s.withColumn("gid", 10_000_000 - F.col("gid")).withColumn("side", F.lit(1)))
    return sides.groupBy("pair").applyInPandas(transport.assigned_pair, "src long, dst long")


@query("planted_order", "select cast(row_number() over (order by (i * 7) % 10 desc) - 1 as int) as place, cast(i as int) as slice_idx from range(10) t(i)")
def planted_order(spark, sf_dir):
    """Slice i's features are moved to place 7 i mod 10 of a line; the path ends at the lesser of its ends, which is slice 0."""
    s = fixtures.spots(spark, sf_dir)
    moved = s.select("gid", "slice_idx", F.transform("vec", lambda v, i: v + F.when(i == 0, 5.0 * ((F.col("slice_idx") * 7) % 10)).otherwise(0.0)).alias("vec"))
    path = ordering.infer_order(moved, OrderConfig(svd_dim=8))
    return spark.createDataFrame(list(enumerate(path)), "place int, slice_idx int")


GROUPS = 20
_GROUPED = f"select gid, min(gid) over (partition by gid % {GROUPS}) as least from spots"


def _named(labels, label="cluster"):
    """Clusters by their least member."""
    return labels.join(labels.groupBy(label).agg(F.min("gid").alias("least")), label).select("gid", "least")


def _cliques(spark, sf_dir):
    """Complete graphs of the spots with equal gid mod 20, joined to a ring by weak edges."""
    s = fixtures.spots(spark, sf_dir).select("gid", (F.col("gid") % GROUPS).alias("g"))
    inside = s.select(F.col("gid").alias("src"), "g").join(s.select(F.col("gid").alias("dst"), "g"), "g").filter("src <> dst").select("src", "dst", F.lit(1.0).alias("w"))
    first = s.groupBy("g").agg(F.min("gid").alias("least"))
    ring = first.join(first.select(((F.col("g") + GROUPS - 1) % GROUPS).alias("g"), F.col("least").alias("next")), "g")
    weak = ring.select(F.col("least").alias("src"), F.col("next").alias("dst"), F.lit(0.01).alias("w"))
    return inside.unionByName(weak).unionByName(weak.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


@query("planted_communities", sql("spots", then=_GROUPED))
def planted_communities(spark, sf_dir):
    return _named(graph.leiden(_cliques(spark, sf_dir)))


@query("planted_communities_joined", sql("spots", then=_GROUPED))
def planted_communities_joined(spark, sf_dir):
    """The same through joins: only the graph of the cliques themselves is left to a task."""
    return _named(graph.leiden(_cliques(spark, sf_dir), passes=1, task_edges=1000))


@query("planted_mixture", sql("spots", then="select gid, min(gid) over (partition by gid % 3) as least from spots"))
def planted_mixture(spark, sf_dir):
    """Three far apart blobs whose graph stays within them."""
    s = fixtures.spots(spark, sf_dir)
    blob = F.transform("vec", lambda v, i: v + F.when(i == F.col("gid") % 3, 20.0).otherwise(0.0))
    edges = s.select(F.col("gid").alias("src"), (F.col("gid") + 3).alias("dst")).join(s.select(F.col("gid").alias("dst")), "dst").select("src", "dst", F.lit(1.0).alias("w"))
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return _named(mixture.gmm(s.select("gid", blob.alias("vec")), both, 3, n_iter=8)[0].select("gid", "cluster"))


# ---- embeddings: what doesn't depend on signs ------------------------------------------------------
@query("svd_norms", sql("spots", then="select gid, round(list_sum(list_transform(vec, lambda v: v * v)), 6) as norm2 from spots"))
def svd_norms(spark, sf_dir):
    """All 64 directions are kept, so the embedding has the rows' own lengths."""
    wide = fixtures.spots(spark, sf_dir).withColumn("vec", F.concat("vec", F.array(F.lit(0.0))))
    return linalg.svd_embedding(wide, 64).select("gid", F.round(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v), 6).alias("norm2"))


@query("sparse_svd_norms", sql("counts", then="select gid, round(sum(t * t), 4) as norm2 from (select gid, gene_idx % 12 as g, sum(value) as t from counts group by all) group by gid"))
def sparse_svd_norms(spark, sf_dir):
    """Genes are summed up to twelve groups, as many as are kept: from sparse counts to features without a loss."""
    entries = fixtures.counts(spark, sf_dir).groupBy("gid", (F.col("gene_idx") % 12).alias("gene_idx")).agg(F.sum("value").alias("value"))
    return linalg.sparse_svd(entries, 12).select("gid", F.round(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v), 4).alias("norm2"))


@query("contrastive_norms", sql("spots", then="select gid, 1.0::double as norm from spots"))
def contrastive_norms(spark, sf_dir):
    s = fixtures.spots(spark, sf_dir)
    found, _ = contrastive.embed(linalg.svd_embedding(s, 16), graph_of(s), ContrastiveConfig(epochs=3, embed_dim=8, hidden_dim=16))
    return found.select("gid", F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))), 4).alias("norm"))


BLOBS = 5


def blobs(spark, sf_dir):
    """(features, edges): five groups told apart by five weak components beside the 64 of the spots; edges stay within a group."""
    s = fixtures.spots(spark, sf_dir).withColumn("g", F.col("gid") % BLOBS)
    x = s.select("gid", F.concat("vec", F.array(*(F.when(F.col("g") == b, 0.5).otherwise(0.0) for b in range(BLOBS)))).alias("vec"))
    step = s.select(F.col("gid").alias("src"), F.explode(F.array(*(F.lit(BLOBS * k) for k in range(1, 9)))).alias("far")).select("src", (F.col("src") + F.col("far")).alias("dst"))
    edges = step.join(s.select(F.col("gid").alias("dst")), "dst").select("src", "dst")
    return x, edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def nearest_blob(found):
    """(gid, nearest): the group whose members' mean is nearest to each unit vector."""
    parts = found.select("gid", (F.col("gid") % BLOBS).alias("g"), F.posexplode("vec").alias("at", "v"))
    mean = parts.groupBy("g", "at").agg(F.avg("v").alias("m"))
    lengths = mean.groupBy("g").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("long"))
    dots = parts.drop("g").join(F.broadcast(mean), "at").groupBy("gid", "g").agg(F.sum(F.col("v") * F.col("m")).alias("dot"))  # five rows for each component
    scored = dots.join(F.broadcast(lengths), "g").groupBy("gid").agg(F.max_by("g", F.col("dot") / F.col("long")).alias("nearest"))
    return scored.select("gid", F.col("nearest").cast("long").alias("nearest"))


@query("planted_contrastive", sql("spots", then=f"select gid, cast(gid % {BLOBS} as bigint) as nearest from spots"))
def planted_contrastive(spark, sf_dir):
    """After training every spot lies nearest to its own group, which an untrained perceptron doesn't reach (a test)."""
    x, edges = blobs(spark, sf_dir)
    config = ContrastiveConfig(epochs=40, embed_dim=16, hidden_dim=64, lr=1e-2, batch_size=256, parallel=2)
    return nearest_blob(contrastive.embed(x, edges, config)[0])


@query("poses_of_all_slices", sql("spots", then="select slice_idx, count(*) as n from spots where slice_idx > 0 group by slice_idx"))
def poses_of_all_slices(spark, sf_dir):
    """Adjacent alignment of the fixture itself gives every slice but the first a pose and keeps all spots."""
    moved, _, poses = registration.align_adjacent(cube_of(spark, sf_dir), registration.Options(svd_dim=16, feature_mode="svd", n_iter=1))
    return moved.spots.join(poses.select("slice_idx"), "slice_idx", "left_semi").groupBy("slice_idx").agg(F.count("*").alias("n"))
