"""Queries over slices, neighbours and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from slabwise import model
from slabwise.operators import graph, neighbors
from slabwise.sources import fixtures
from slabwise.sources.fixtures import sql

from .catalog import query

K_INTRA, K_INTER, RADIUS, LAMBDA_Z = 15, 5, 0.6, 0.01
#: Neighbours in the queries over features, and of those in mapping.
K_MAP = 5

_R = lambda c, a=None: F.round(c, 6).alias(a or c)

# ---- DuckDB pieces -------------------------------------------------------------------------------
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
VEC_D2 = "list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def intra_sql(k: int = K_INTRA, view: str = "spots") -> str:
    return f"""intra as (select * from (select a.slice_idx, a.gid as src, b.gid as dst, {D2} as d2,
  row_number() over (partition by a.gid order by {D2}, b.gid) as rank
  from {view} a join {view} b on a.slice_idx = b.slice_idx and a.gid <> b.gid) where rank <= {k})"""


def inter_sql(k: int = K_INTER) -> str:
    one = lambda step: f"""select a.slice_idx as src_slice, a.gid as src, b.gid as dst, {D2} + {LAMBDA_Z}::double as d2,
  row_number() over (partition by a.gid order by {D2}, b.gid) as rank, {'true' if step == 1 else 'false'} as forward
  from spots a join spots b on b.slice_idx = a.slice_idx + {step}"""  # noqa: E731
    return f"inter as (select * from ({one(1)}) where rank <= {k} union all select * from ({one(-1)}) where rank <= {k})"


def mapping_sql(k: int = K_MAP) -> str:
    return f"""mapping as (select * from (select a.gid as gid_hi, b.gid as gid_lo, a.slice_idx as slice_hi, {VEC_D2} as d2,
  row_number() over (partition by a.gid order by {VEC_D2}, b.gid) as rank
  from spots a join spots b on b.slice_idx = a.slice_idx - 1) where rank <= {k})"""


GRAPH_SQL = """sig as (select slice_idx, median(sqrt(d2)) as s from intra group by 1),
sigx as (select src_slice as low, median(sqrt(d2)) as s from inter where forward group by 1),
directed as (select src, dst, exp(-d2 / greatest(s * s, 1e-12)) as w from intra join sig using (slice_idx)
  union all select src, dst, exp(-d2 / greatest(s * s, 1e-12)) from inter join sigx on low = case when forward then src_slice else src_slice - 1 end
  union all select gid_hi, gid_lo, 2.0::double from mapping where rank <= 5),
edges as (select src, dst, sum(w) as w from (select src, dst, w from directed union all select dst, src, w from directed) group by all)"""


def mapping_of(spots):
    """map_to_prev: for each spot the nearest spots of the slice before, by features."""
    return neighbors.feature_knn(spots, K_MAP, step=-1).join(spots.select(F.col("gid").alias("src"), F.col("slice_idx").alias("slice_hi")), "src").select(
        F.col("src").alias("gid_hi"), F.col("dst").alias("gid_lo"), "slice_hi", "d2", "rank"
    )


def graph_of(spots):
    return graph.weighted_graph(spots, K_INTRA, K_INTER, mapping=mapping_of(spots), lambda_z=LAMBDA_Z)


# ---- slices --------------------------------------------------------------------------------------
def _merged(spark, sf_dir):
    return fixtures.spots(spark, sf_dir).select(F.col("gid").alias("row"), F.col("slice_id").alias("sampleid"), F.col("x").alias("coor_x_ad2"), F.col("y").alias("coor_y_ad2"))


@query("split_slices", sql("spots", then="""select slice_id, cast(dense_rank() over (order by slice_id) - 1 as int) as slice_idx,
  cast(row_number() over (partition by slice_id order by gid) - 1 as int) as spot_idx, gid as row,
  cast(row_number() over (order by slice_id, gid) - 1 as bigint) as gid from spots"""))
def split_slices(spark, sf_dir):
    return model.spots_from(_merged(spark, sf_dir), "sampleid", "row").select("slice_id", "slice_idx", "spot_idx", "row", "gid")


@query("derive_coordinates", sql("spots", then="select gid as row, round(x, 6) as x, round(y, 6) as y from spots"))
def derive_coordinates(spark, sf_dir):
    return model.spots_from(_merged(spark, sf_dir), "sampleid", "row").select("row", _R("x"), _R("y"))


@query("slice_infos", sql("spots", then="select slice_idx, case when count(distinct slice_id) = 1 then min(slice_id) else 'unknown' end as slice_id, cast(slice_idx * 3.0 + 2.0 as double) as z, count(*) as n_obs from spots group by slice_idx"))
def slice_infos(spark, sf_dir):
    return model.Cube(fixtures.spots(spark, sf_dir), z_spacing=3.0, z_base=2.0).slices().select("slice_idx", "slice_id", "z", "n_obs")


@query("gid_offsets", sql("spots", then="select slice_idx, cast(coalesce(sum(n) over (order by slice_idx rows between unbounded preceding and 1 preceding), 0) as bigint) as gid_offset from (select slice_idx, count(*) as n from spots group by 1)"))
def gid_offsets(spark, sf_dir):
    return model.Cube(fixtures.spots(spark, sf_dir)).slices().select("slice_idx", F.col("gid_offset").cast("long").alias("gid_offset"))


@query("z_positions", sql("spots", then="select distinct slice_idx, cast(slice_idx * 3.0 + 2.0 as double) as z from spots"))
def z_positions(spark, sf_dir):
    return model.Cube(fixtures.spots(spark, sf_dir), z_spacing=3.0, z_base=2.0).slices().select("slice_idx", "z")


@query("spatial_3d", sql("spots", then="select gid, round(x, 6) as x, round(y, 6) as y, cast(slice_idx as double) as z from spots"))
def spatial_3d(spark, sf_dir):
    return model.Cube(fixtures.spots(spark, sf_dir)).spots_3d().select("gid", _R("x"), _R("y"), "z")


@query("scaled_3d", sql("spots", then="select gid, round(x, 6) as x, round(y, 6) as y, round(slice_idx * sqrt(0.01::double), 6) as z from spots"))
def scaled_3d(spark, sf_dir):
    return model.Cube(fixtures.spots(spark, sf_dir), lambda_z=0.01).spots_3d(scaled=True).select("gid", _R("x"), _R("y"), _R("z"))


@query("raw_snapshot", sql("spots", then="select gid as row, round(x, 6) as x_raw, round(y, 6) as y_raw, round(x + 1, 6) as x, round(y - 1, 6) as y from spots"))
def raw_snapshot(spark, sf_dir):
    moved = model.spots_from(_merged(spark, sf_dir), "sampleid", "row").withColumns({"x": F.col("x") + 1, "y": F.col("y") - 1})
    return moved.select("row", _R("x_raw"), _R("y_raw"), _R("x"), _R("y"))


@query("slice_filter", sql("spots", then="select gid from spots where slice_id = 'S03'"))
def slice_filter(spark, sf_dir):
    return fixtures.spots(spark, sf_dir).filter(F.col("slice_id") == "S03").select("gid")


@query("bounding_box", sql("cspots", then="select slice_idx, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, count(*) as n from cspots group by 1"))
def bounding_box(spark, sf_dir):
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)]
    return fixtures.count_spots(spark, sf_dir).groupBy("slice_idx").agg(*ends, F.count("*").alias("n"))


@query("union_slices", sql("spots", then="select gid, cast(dense_rank() over (order by slice_idx) - 1 as int) as slice_idx from spots"))
def union_slices(spark, sf_dir):
    s = fixtures.spots(spark, sf_dir)
    keys = [r["slice_idx"] for r in s.select("slice_idx").distinct().orderBy("slice_idx").collect()]  # a row for each slice
    parts = [s.filter(F.col("slice_idx") == k).drop("slice_idx") for k in keys]
    return model.cube_from_list(parts, [float(i) for i in range(len(keys))]).spots.select("gid", "slice_idx")


@query("distinct_labels", sql("spots", then="select slice_idx, count(distinct slice_id) as n_ids from spots group by 1"))
def distinct_labels(spark, sf_dir):
    return fixtures.spots(spark, sf_dir).groupBy("slice_idx").agg(F.count_distinct("slice_id").alias("n_ids"))


@query("label_writeback", sql("spots", then="select gid, cast(gid % 7 as int) as cluster from spots"))
def label_writeback(spark, sf_dir):
    s = fixtures.spots(spark, sf_dir)
    return model.Cube(s).with_clusters(s.select("gid", (F.col("gid") % 7).alias("cluster"))).spots.select("gid", "cluster")


@query("embedding_writeback", sql("spots", then="select gid, slice_idx, round(sqrt(list_sum(list_transform(vec, lambda v: v * v))), 6) as norm from spots"))
def embedding_writeback(spark, sf_dir):
    from slabwise.functions.arrays import norm

    s = fixtures.spots(spark, sf_dir)
    return s.select("gid", "slice_idx").join(s.select("gid", "vec"), "gid").select("gid", "slice_idx", F.round(norm("vec"), 6).alias("norm"))


@query("meta_rows", sql("spots", then="select s.slice_idx, 'align' as scope, k.key, k.value from (select distinct slice_idx from spots) s, (values ('lambda_z', '0.01'), ('n_iter', '3')) k(key, value)"))
def meta_rows(spark, sf_dir):
    return model.metadata(model.Cube(fixtures.spots(spark, sf_dir)), "align", {"lambda_z": 0.01, "n_iter": 3})


# ---- neighbours ----------------------------------------------------------------------------------
@query("knn_intra", sql("spots", intra_sql(), then="select slice_idx, src, dst, rank, round(d2, 6) as d2 from intra"))
def knn_intra(spark, sf_dir):
    return neighbors.knn_within(fixtures.spots(spark, sf_dir), K_INTRA).select("slice_idx", "src", "dst", F.col("rank").cast("long").alias("rank"), _R("d2"))


@query("knn_lattice", sql("cspots", intra_sql(5, "cspots"), then="select src, count(*) as n, max(rank) as last, round(max(d2), 6) as far, cast(sum(dst) as bigint) as ids from intra group by src"))
def knn_lattice(spark, sf_dir):
    found = neighbors.knn_within(fixtures.count_spots(spark, sf_dir), 5)
    return found.groupBy("src").agg(F.count("*").alias("n"), F.max("rank").cast("long").alias("last"), F.round(F.max("d2"), 6).alias("far"), F.sum("dst").alias("ids"))


@query("radius_intra", sql("spots", then=f"select a.slice_idx, a.gid as src, b.gid as dst, round({D2}, 6) as d2 from spots a join spots b on a.slice_idx = b.slice_idx and a.gid <> b.gid where {D2} <= {RADIUS}::double * {RADIUS}::double"))
def radius_intra(spark, sf_dir):
    return neighbors.radius_within(fixtures.spots(spark, sf_dir), RADIUS).select("slice_idx", "src", "dst", _R("d2"))


@query("knn_inter", sql("spots", inter_sql(), then="select src_slice, src, dst, rank, forward, round(d2, 6) as d2 from inter"))
def knn_inter(spark, sf_dir):
    return neighbors.knn_across(fixtures.spots(spark, sf_dir), K_INTER, LAMBDA_Z).select("src_slice", "src", "dst", F.col("rank").cast("long").alias("rank"), "forward", _R("d2"))


@query("radius_inter", sql("spots", then=f"select a.slice_idx as src_slice, a.gid as src, b.gid as dst, round({D2} + 0.01::double, 6) as d2 from spots a join spots b on b.slice_idx = a.slice_idx + 1 where {D2} <= {RADIUS}::double * {RADIUS}::double - 0.01::double"))
def radius_inter(spark, sf_dir):
    return neighbors.radius_across(fixtures.spots(spark, sf_dir), RADIUS, LAMBDA_Z).select("src_slice", "src", "dst", _R("d2"))


@query("expr_knn_map", sql("spots", mapping_sql(), then="select gid_hi, gid_lo, slice_hi, rank, round(d2, 6) as d2 from mapping"))
def expr_knn_map(spark, sf_dir):
    return mapping_of(fixtures.spots(spark, sf_dir)).select("gid_hi", "gid_lo", "slice_hi", F.col("rank").cast("long").alias("rank"), _R("d2"))


@query("mapping_edges", sql("spots", mapping_sql(), then="select src, dst, 2.0::double as w from (select gid_hi as src, gid_lo as dst from mapping where rank <= 3 union all select gid_lo, gid_hi from mapping where rank <= 3)"))
def mapping_edges(spark, sf_dir):
    """The weighted graph's mapped pairs: all other edges weigh nothing and go."""
    s = fixtures.spots(spark, sf_dir)
    return graph.weighted_graph(s, K_INTRA, 3, mapping=mapping_of(s), alpha_intra=0.0, gamma_inter=0.0, lambda_z=LAMBDA_Z)


MUTUAL_SQL = f"""near as (select * from (select a.slice_idx as i, b.slice_idx as j, a.gid as u, b.gid as v,
  row_number() over (partition by a.gid, b.slice_idx order by {VEC_D2}, b.gid) as rank
  from spots a join spots b on a.slice_idx <> b.slice_idx) where rank <= 10)"""


@query("mutual_knn", sql("spots", MUTUAL_SQL, then="""select a.i, a.j, count(*) as mutual, round(count(*) / (any_value(c.n) * least(10, any_value(d.n)) + 1e-12::double), 6) as similarity
  from near a join near b on a.u = b.v and a.v = b.u join (select slice_idx, count(*) as n from spots group by 1) c on c.slice_idx = a.i
  join (select slice_idx, count(*) as n from spots group by 1) d on d.slice_idx = a.j group by a.i, a.j"""))
def mutual_knn(spark, sf_dir):
    from slabwise.operators.ordering import mutual_similarity

    return mutual_similarity(fixtures.spots(spark, sf_dir), 10).select("i", "j", "mutual", _R("similarity"))


@query("expr_knn_pruned", sql("spots", then=f"""select * from (select a.gid as src, b.gid as dst, round({VEC_D2}, 6) as d2, row_number() over (partition by a.gid order by {VEC_D2}, b.gid) as rank
  from spots a join spots b on a.gid <> b.gid) where rank <= {K_MAP}"""))
def expr_knn_pruned(spark, sf_dir):
    rows = fixtures.spots(spark, sf_dir).select(F.lit(0).alias("part"), "gid", "vec")
    return neighbors.vector_knn(rows, rows, K_MAP, block=128).select("src", "dst", _R("d2"), "rank")


@query("subsample", sql("spots", then="select gid from (select gid, row_number() over (partition by slice_idx order by md5('0:' || cast(gid as varchar)), gid) as n from spots) where n <= 10"))
def subsample(spark, sf_dir):
    return neighbors.subsample(fixtures.spots(spark, sf_dir), 10).select("gid")


@query("paired_subsample", sql("spots", f"""smp as (select * from (select *, row_number() over (partition by slice_idx order by md5('0:' || cast(gid as varchar)), gid) as n from spots) where n <= 20 and slice_idx > 0),
  one as (select a.gid, b.gid as target, a.slice_idx, row_number() over (partition by a.gid order by {VEC_D2}, b.gid) as r from smp a join spots b on b.slice_idx = a.slice_idx - 1)""",
  then="select distinct slice_idx, target from one where r = 1"))
def paired_subsample(spark, sf_dir):
    s = fixtures.spots(spark, sf_dir)
    nearest = neighbors.feature_knn(s, 1, step=-1)
    picked = neighbors.subsample(s, 20).filter("slice_idx > 0").select(F.col("gid").alias("src"), "slice_idx")
    return nearest.join(picked, "src").select("slice_idx", F.col("dst").alias("target")).distinct()


# ---- graphs --------------------------------------------------------------------------------------
@query("sigma_median", sql("spots", intra_sql(), then="select slice_idx, round(median(sqrt(d2)), 6) as sigma from intra group by 1"))
def sigma_median(spark, sf_dir):
    return graph.median_distance(neighbors.knn_within(fixtures.spots(spark, sf_dir), K_INTRA), ["slice_idx"]).select("slice_idx", _R("sigma"))


@query("weighted_graph", sql("spots", intra_sql(), inter_sql(), mapping_sql(), GRAPH_SQL, then="select src, dst, round(w, 6) as w from edges"))
def weighted_graph(spark, sf_dir):
    return graph_of(fixtures.spots(spark, sf_dir)).select("src", "dst", _R("w"))


@query("weighted_graph_radius", sql("spots", f"""rin as (select a.slice_idx as part, a.gid as src, b.gid as dst, {D2} as d2 from spots a join spots b on a.slice_idx = b.slice_idx and a.gid <> b.gid where {D2} <= 0.36),
rout as (select a.slice_idx as part, a.gid as src, b.gid as dst, {D2} + 0.01::double as d2 from spots a join spots b on b.slice_idx = a.slice_idx + 1 where {D2} <= {RADIUS}::double * {RADIUS}::double - 0.01::double),
wd as (select src, dst, exp(-d2 / greatest(s * s, 1e-12)) as w from rin join (select part, median(sqrt(d2)) as s from rin group by 1) using (part)
  union all select src, dst, exp(-d2 / greatest(s * s, 1e-12)) from rout join (select part, median(sqrt(d2)) as s from rout group by 1) using (part))""",
  then="select src, dst, round(sum(w), 6) as w from (select * from wd union all select dst, src, w from wd) group by src, dst having sum(w) <> 0"))
def weighted_graph_radius(spark, sf_dir):
    return graph.weighted_graph(fixtures.spots(spark, sf_dir), radius_intra=0.6, radius_inter=RADIUS, lambda_z=LAMBDA_Z).select("src", "dst", _R("w"))


@query("adjacency", sql("spots", intra_sql(), inter_sql(), then="select distinct src, dst, 1.0::double as w from (select src, dst from intra union all select dst, src from intra union all select src, dst from inter union all select dst, src from inter)"))
def adjacency(spark, sf_dir):
    return graph.adjacency(fixtures.spots(spark, sf_dir), K_INTRA, K_INTER, lambda_z=LAMBDA_Z)


@query("adjacency_mapped", sql("spots", intra_sql(), mapping_sql(), then="select distinct src, dst, 1.0::double as w from (select src, dst from intra union all select dst, src from intra union all select gid_hi, gid_lo from mapping union all select gid_lo, gid_hi from mapping)"))
def adjacency_mapped(spark, sf_dir):
    s = fixtures.spots(spark, sf_dir)
    return graph.adjacency(s, K_INTRA, K_INTER, mapping=mapping_of(s), lambda_z=LAMBDA_Z)


_FULL = ("spots", intra_sql(), inter_sql(), mapping_sql(), GRAPH_SQL)


@query("degree", sql(*_FULL, then="select src, round(sum(w), 6) as degree from edges group by 1"))
def degree(spark, sf_dir):
    return graph.degree(graph_of(fixtures.spots(spark, sf_dir))).select("src", _R("degree"))


@query("row_normalize", sql(*_FULL, then="select src, dst, round(w / (sum(w) over (partition by src) + 1e-12::double), 6) as w from edges"))
def row_normalize(spark, sf_dir):
    return graph.row_normalised(graph_of(fixtures.spots(spark, sf_dir))).select("src", "dst", _R("w"))


@query("union_edges", sql("spots", intra_sql(), inter_sql(), then="select kind, count(*) as n from (select 'intra' as kind from intra union all select 'inter' from inter) group by 1"))
def union_edges(spark, sf_dir):
    s = fixtures.spots(spark, sf_dir)
    intra = neighbors.knn_within(s, K_INTRA).select(F.lit("intra").alias("kind"))
    return intra.unionByName(neighbors.knn_across(s, K_INTER, LAMBDA_Z).select(F.lit("inter").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("no_self_edges", sql(*_FULL, then="select count(*) as n, count(*) filter (where src = dst) as loops, count(*) filter (where w = 0) as zeros from edges"))
def no_self_edges(spark, sf_dir):
    return graph_of(fixtures.spots(spark, sf_dir)).agg(F.count("*").alias("n"), F.count_if(F.col("src") == F.col("dst")).alias("loops"), F.count_if(F.col("w") == 0).alias("zeros"))


@query("ordered_edges", sql(*_FULL, then="select src, dst from edges order by src, dst limit 50"))
def ordered_edges(spark, sf_dir):
    return graph_of(fixtures.spots(spark, sf_dir)).select("src", "dst").orderBy("src", "dst").limit(50)


@query("positive_sample", sql(*_FULL, then="select gid, coalesce(dst, gid) as positive from spots left join (select src, dst, row_number() over (partition by src order by md5('0:' || src || ':' || dst), dst) as n from edges) on src = gid and n = 1 where n = 1 or n is null"))
def positive_sample(spark, sf_dir):
    from slabwise.operators.contrastive import positives

    s = fixtures.spots(spark, sf_dir)
    return positives(s, graph_of(s), 0)


@query("leiden")
def leiden(spark, sf_dir):
    return graph.leiden(graph_of(fixtures.spots(spark, sf_dir)))
