"""The jobs as registered queries: each runs twice into one new folder and returns what stands there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slabwise.plans.graphs import D2
from slabwise.session import shared_folder
from slabwise.sources.fixtures import sql

from . import neighbourhood_atlas, word_profiles

QUERIES, ORACLES = {}, {}


def _query(name: str, oracle: str):
    def put(fn):
        QUERIES[name], ORACLES[name] = fn, oracle
        return fn

    return put


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _edges_sql(n_intra: int, n_inter: int, extra: float) -> str:
    """DuckDB's table `edges` (src, dst, w) of the geometric graph."""
    ranked = lambda step, fields: f"select {fields}, row_number() over (partition by a.gid order by {D2}, b.gid) as rank from spots a join spots b on b.slice_idx = a.slice_idx + {step} and a.gid <> b.gid"
    across = lambda step, low: f"select * from ({ranked(step, f'{low} as low, a.gid as src, b.gid as dst, {D2} + {extra}::double as d2, {step} = 1 as forward')}) where rank <= {n_inter}"
    return f"""intra as (select * from ({ranked(0, f'a.slice_idx, a.gid as src, b.gid as dst, {D2} as d2')}) where rank <= {n_intra}),
inter as ({across(1, 'a.slice_idx')} union all {across(-1, 'a.slice_idx - 1')}),
sig as (select slice_idx, median(sqrt(d2)) as s from intra group by 1),
sigx as (select low, median(sqrt(d2)) as s from inter where forward group by 1),
directed as (select src, dst, exp(-d2 / greatest(s * s, 1e-12)) as w from intra join sig using (slice_idx)
  union all select src, dst, exp(-d2 / greatest(s * s, 1e-12)) from inter join sigx using (low)),
edges as (select src, dst, sum(w) as w from (select src, dst, w from directed union all select dst, src, w from directed) group by all having sum(w) <> 0)"""


@_query("job1_neighbourhood_atlas", sql("spots", _edges_sql(8, 4, 0.01), then="""select a.gid, a.slice_idx, round(a.x, 6) as x, round(a.y, 6) as y, a.slice_idx * 1.0::double as z, count(e.dst) as n_neighbours,
  round(coalesce(sum(e.w), 0), 6) as strength, round(coalesce(sum(e.w) filter (where b.slice_idx <> a.slice_idx), 0), 6) as across
  from spots a left join edges e on e.src = a.gid left join spots b on b.gid = e.dst group by all"""))
def job1(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = _new_folder(spark, "job1")
    for _ in range(2):
        neighbourhood_atlas.run(spark, f"{sf_dir}/embeddings.parquet", output)
    r = lambda c: F.round(c, 6).alias(c)
    return neighbourhood_atlas.result(spark, output).select("gid", "slice_idx", r("x"), r("y"), "z", "n_neighbours", r("strength"), r("across"))


@_query("job2_word_profiles", """with words as (
  select coalesce(source, 'nan') as slice, row_number() over () as unit,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as feature from documents),
sums as (select slice, feature, count(distinct unit) as n_units, count(*) as total from words group by all),
kept as (select * from sums where n_units >= 5 and total >= 10 and not starts_with(feature, 'http')),
present as (select feature, count(*) as n_slices from kept group by 1),
placed as (select *, row_number() over (partition by slice order by total desc, feature) as place from kept)
select slice, feature, n_units, total, case when n_slices >= 2 then n_slices else 0 end as n_slices, case when place <= 100 then cast(place as int) end as place
from placed join present using (feature)""")
def job2(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _new_folder(spark, "job2")
    for _ in range(2):
        word_profiles.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/output", f"{folder}/checkpoint")
    return word_profiles.result(spark, f"{folder}/output")
