"""Queries over sparse features, multiple testing, plot tables and files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from slabwise.functions.palette import PALETTE
from slabwise.operators import svg, viz
from slabwise.session import ensure_checkpoint_dir
from slabwise.sources import files, fixtures
from slabwise.sources.fixtures import sql

from .catalog import query

_R = lambda c, a=None: F.round(c, 6).alias(a or c)
LEAST_TOTAL = 100

_KEPT = f"ks as (select gid from counts group by gid having sum(value) >= {LEAST_TOTAL}), kc as (select counts.* from counts join ks using (gid))"
_GENES = "gn as (select gene_idx, any_value(gene) as gene, sum(value) as total, count(*) filter (value > 0) as nonzero from kc group by gene_idx)"


def kept(spark, sf_dir):
    spots, counts = fixtures.count_spots(spark, sf_dir), fixtures.counts(spark, sf_dir)
    ids = svg.filter_spots(spots, counts, LEAST_TOTAL)
    return spots.join(ids, "gid", "left_semi"), counts.join(ids, "gid", "left_semi")


@query("spot_totals", sql("counts", then="select gid, sum(value) as total from counts group by gid"))
def spot_totals(spark, sf_dir):
    return svg.spot_totals(fixtures.count_spots(spark, sf_dir), fixtures.counts(spark, sf_dir))


@query("spot_filter", sql("counts", then=f"select gid from counts group by gid having sum(value) >= {LEAST_TOTAL}"))
def spot_filter(spark, sf_dir):
    return svg.filter_spots(fixtures.count_spots(spark, sf_dir), fixtures.counts(spark, sf_dir), LEAST_TOTAL)


@query("gene_filter", sql("counts", _KEPT, _GENES, then="select gene_idx, gene, total, nonzero from gn where nonzero >= 20 and total >= 500 and not (gene like 'mt-%' or gene like 'MT-%')"))
def gene_filter(spark, sf_dir):
    return svg.filter_genes(kept(spark, sf_dir)[1], 20, 500)


@query("gene_prefix_filter", sql("counts", then="select distinct gene from counts where not starts_with(gene, 'mt-')"))
def gene_prefix_filter(spark, sf_dir):
    return svg.without_prefixes(fixtures.counts(spark, sf_dir).select("gene").distinct())


@query("max_genes_topk", sql("counts", _KEPT, _GENES, then="select gene_idx, total from gn where nonzero >= 5 and total >= 10 and not starts_with(gene, 'mt-') order by total desc, gene_idx limit 100"))
def max_genes_topk(spark, sf_dir):
    return svg.filter_genes(kept(spark, sf_dir)[1], most=100).select("gene_idx", "total")


@query("gene_presence", sql("counts", then="select gene, count(*) as slices from (select slice_idx, gene from counts group by all having sum(value) >= 40) group by gene having count(*) >= 5"))
def gene_presence(spark, sf_dir):
    per_slice = fixtures.counts(spark, sf_dir).groupBy("slice_idx", "gene").agg(F.sum("value").alias("t")).filter("t >= 40")
    return svg.presence(per_slice.select("slice_idx", "gene"), 5)


@query("gene_list", sql("counts", then="select distinct gene from counts order by gene"))
def gene_list(spark, sf_dir):
    return fixtures.counts(spark, sf_dir).select("gene").distinct().orderBy("gene")


@query("gene_subset", sql("counts", then="select gid, gene_idx, value from counts where gene_idx in (1, 5, 11)"))
def gene_subset(spark, sf_dir):
    wanted = spark.createDataFrame([(1,), (5,), (11,)], "gene_idx long")
    return fixtures.counts(spark, sf_dir).join(F.broadcast(wanted), "gene_idx", "left_semi").select("gid", "gene_idx", "value")


@query("mask_and", sql("counts", _KEPT, _GENES, then="select gene_idx, nonzero >= 20 as a, total >= 500 as b, nonzero >= 20 and total >= 500 as both from gn"))
def mask_and(spark, sf_dir):
    a, b = F.col("nonzero") >= 20, F.col("total") >= 500
    return svg.gene_totals(kept(spark, sf_dir)[1]).select("gene_idx", a.alias("a"), b.alias("b"), (a & b).alias("both"))


@query("int_check", sql("counts", then="select bool_and(value % 1 = 0) as is_integer from (select value from counts where value <> 0 order by gid, gene_idx limit 100)"))
def int_check(spark, sf_dir):
    return svg.looks_integer(fixtures.counts(spark, sf_dir))


@query("cluster_counts", sql("spots", then="select slice_idx as cluster, count(*) as n from spots group by 1 order by n desc, cluster limit 5"))
def cluster_counts(spark, sf_dir):
    return fixtures.spots(spark, sf_dir).groupBy(F.col("slice_idx").alias("cluster")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").limit(5)


@query("head_n", sql("spots", then="select gid, slice_id from spots order by gid limit 10"))
def head_n(spark, sf_dir):
    return fixtures.spots(spark, sf_dir).select("gid", "slice_id").orderBy("gid").limit(10)


_BH = """rk as (select gene, p, row_number() over (order by p, gene) as r, count(*) over () as m from pvalues where p is not null),
bh as (select gene, p, least(1.0, min(p * m / r) over (order by p desc, gene desc rows unbounded preceding)) as adjusted from rk)"""


def _tests(spark, sf_dir):
    # p-values of the fixture exceed 1 for many events; the rule is the same
    return fixtures.pvalues(spark, sf_dir)


@query("bh_adjust", sql("pvalues", _BH, then="select gene, round(p, 6) as p, round(adjusted, 6) as adjusted from bh"))
def bh_adjust(spark, sf_dir):
    return svg.bh_adjust(_tests(spark, sf_dir)).select("gene", _R("p"), _R("adjusted"))


@query("top_genes", sql("pvalues", then="select gene, round(p, 6) as p from pvalues order by p, gene limit 50"))
def top_genes(spark, sf_dir):
    return svg.top_genes(_tests(spark, sf_dir), 50, "adjusted", fallback="p").select("gene", _R("p"))


@query("sparkx_statistic", sql("counts", "cspots", f"""ks as (select gid from counts group by gid having sum(value) >= 1),
  sp as (select gid, x - avg(x) over () as a, y - avg(y) over () as b from cspots join ks using (gid)),
  mm as (select sum(a*a) as aa, sum(a*b) as ab, sum(b*b) as bb, count(*) as n from sp),
  sg as (select gene_idx, sum(value) as t, sum(value*value) as tt, sum(value*a) as u, sum(value*b) as v, count(*) as k from counts join sp using (gid) where not starts_with(gene, 'mt-') group by 1 having count(*) filter (value > 0) >= 5 and sum(value) >= 10)""",
  then="select gene_idx, round(exp(-n / 2.0 * least(1.0, (bb*u*u - 2*ab*u*v + aa*v*v) / (aa*bb - ab*ab) / (tt - t*t/n))), 6) as p1 from sg, mm"))
def sparkx_statistic(spark, sf_dir):
    return svg.spatially_variable(fixtures.count_spots(spark, sf_dir), fixtures.counts(spark, sf_dir)).select("gene_idx", _R("p1"))


def _sparkx_sql() -> str:
    """The whole test: eleven pairs of transformed coordinates, the Cauchy rule, the adjustment."""
    shares, cols = (20, 40, 60, 80, 100), ["a", "b"]
    for form in ("exp(-{c} * {c} / (2 * q{c}{s} * q{c}{s}))", "cos(2 * pi() * {c} / q{c}{s})"):
        cols += [form.format(c=c, s=s) for s in shares for c in ("a", "b")]
    q = ", ".join(f"quantile_cont(abs({c}), {s / 100}) as q{c}{s}" for c in ("a", "b") for s in shares)
    raw = ", ".join(f"{x} as r{i}" for i, x in enumerate(cols))
    centred = ", ".join(f"r{i} - avg(r{i}) over () as s{i}" for i in range(len(cols)))
    pairs = range(len(cols) // 2)
    moments = ", ".join(f"sum(s{2 * k} * s{2 * k}) as a{k}, sum(s{2 * k} * s{2 * k + 1}) as b{k}, sum(s{2 * k + 1} * s{2 * k + 1}) as d{k}" for k in pairs)
    sums = ", ".join(f"sum(value * s{i}) as c{i}" for i in range(len(cols)))
    p = lambda k: f"""case when tt - t * t / n > 1e-12 then exp(-n / 2.0 * least(1.0, case when a{k} * d{k} - b{k} * b{k} > 1e-12 * a{k} * d{k}
      then (d{k} * c{2 * k} * c{2 * k} - 2 * b{k} * c{2 * k} * c{2 * k + 1} + a{k} * c{2 * k + 1} * c{2 * k + 1}) / (a{k} * d{k} - b{k} * b{k}) else c{2 * k} * c{2 * k} / a{k} end / (tt - t * t / n))) else 1.0 end as p{k}"""  # noqa: E731
    tans = " + ".join(f"tan((0.5 - greatest(1e-15, least(p{k}, 1 - 1e-9))) * pi())" for k in pairs)
    return sql("counts", "cspots", f"""ks as (select gid from counts group by gid having sum(value) >= 1),
      sp as (select gid, x - avg(x) over () as a, y - avg(y) over () as b from cspots join ks using (gid)),
      qq as (select {q} from sp), kr as (select gid, {raw} from sp, qq), kc as (select gid, {centred} from kr), mm as (select {moments}, count(*) as n from kc),
      sg as (select gene_idx, any_value(gene) as gene, sum(value) as t, sum(value * value) as tt, {sums} from counts join kc using (gid) where not starts_with(gene, 'mt-')
             group by gene_idx having count(*) filter (value > 0) >= 5 and sum(value) >= 10),
      ps as (select gene_idx, gene, {', '.join(map(p, pairs))} from sg, mm),
      cb as (select gene_idx, gene, greatest(0.0, 0.5 - atan(({tans}) / {len(pairs)}) / pi()) as p from ps),
      rk as (select *, row_number() over (order by p, gene) as r, count(*) over () as m from cb)""",
      then="select gene_idx, round(p, 6) as combined, round(least(1.0, min(p * m / r) over (order by p desc, gene desc rows unbounded preceding)), 6) as adjusted from rk")


@query("sparkx_test", _sparkx_sql())
def sparkx_test(spark, sf_dir):
    return svg.spatially_variable(fixtures.count_spots(spark, sf_dir), fixtures.counts(spark, sf_dir)).select("gene_idx", _R("combined"), _R("adjusted"))


# ---- plots ---------------------------------------------------------------------------------------
_COLOURS = "[" + ", ".join(f"'{c}'" for c in PALETTE) + "]"


@query("palette_traces", sql("spots", then=f"select slice_idx as code, {_COLOURS}[slice_idx % 8 + 1] as colour, cast(count(*) as int) as n, round(sum(x), 6) as sx from spots group by slice_idx"))
def palette_traces(spark, sf_dir):
    points = fixtures.spots(spark, sf_dir).withColumn("z", F.col("slice_idx").cast("double"))
    return viz.traces(points, "slice_idx").select("code", "colour", "n", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 6).alias("sx"))


@query("label_codes", sql("spots", then="select gid, cast(dense_rank() over (order by slice_id) - 1 as int) as code from spots"))
def label_codes(spark, sf_dir):
    return viz.label_codes(fixtures.spots(spark, sf_dir), "slice_id").select("gid", "code")


@query("scatter_table", sql("spots", then="select gid, round(x, 6) as x, round(list_sum(vec), 6) as value from spots"))
def scatter_table(spark, sf_dir):
    points = fixtures.spots(spark, sf_dir).withColumns({"z": F.lit(0.0), "total": F.aggregate("vec", F.lit(0.0), lambda s, v: s + v)})
    return viz.scatter_table(points, "total").select("gid", _R("x"), _R("value"))


# ---- files ---------------------------------------------------------------------------------------
def _scratch(spark, name: str) -> str:
    """A folder of its own beneath the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("mtx_roundtrip", sql("counts", then="select g, s, value from (select dense_rank() over (order by gene_idx) as g, dense_rank() over (order by gid) as s, value from counts)"))
def mtx_roundtrip(spark, sf_dir):
    files.write_matrix(fixtures.counts(spark, sf_dir), path := _scratch(spark, "matrix"))
    return files.read_matrix(spark, path)


@query("results_roundtrip", sql("pvalues", then="select gene, round(p, 6) as p from pvalues"))
def results_roundtrip(spark, sf_dir):
    tests = fixtures.pvalues(spark, sf_dir)
    tests.write.csv(path := _scratch(spark, "results"), header=True)
    return files.read_results(spark, path, "gene long, p double", tests.select("gene")).select("gene", _R("p"))


@query("read_merged", "select vec_id as gid, round(vec_id / 2.0::double, 6) as x, round(label::double, 6) as y from embeddings")
def read_merged(spark, sf_dir):
    fixtures.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") / 2.0).alias("coor_x_ad2"), F.col("label").alias("coor_y_ad2")).write.parquet(path := _scratch(spark, "merged"))
    return files.read_merged(spark, path).select(F.col("vec_id").alias("gid"), _R("x"), _R("y"))


@query("csv_roundtrip", sql("cspots", then="select gid, x, y from cspots"))
def csv_roundtrip(spark, sf_dir):
    files.write_coordinates(fixtures.count_spots(spark, sf_dir), path := _scratch(spark, "coordinates"))
    return files.read_coordinates(spark, path)


@query("text_roundtrip", sql("counts", then="select distinct gene as value from counts"))
def text_roundtrip(spark, sf_dir):
    files.write_genes(fixtures.counts(spark, sf_dir).select("gene").distinct(), path := _scratch(spark, "genes"))
    return spark.read.text(path)
