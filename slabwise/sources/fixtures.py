"""The engine's input views on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry and features: (gid, slice_idx, slice_id, x, y, vec)."""
    e = lambda i: 10.0 * F.element_at("embedding", i).cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("gid"),
        F.col("label").alias("slice_idx"),
        F.concat(F.lit("S"), F.lpad(F.col("label").cast("string"), 2, "0")).alias("slice_id"),
        e(1).alias("x"),
        e(2).alias("y"),
        F.transform("embedding", lambda v: v.cast("double")).alias("vec"),
    )


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse expression: (gid, slice_idx, gene_idx, gene, value); a spot's rows stand together, so that sums and joins by gid need no further exchange."""
    gene = F.concat(F.when(F.col("gene_idx") % 50 == 0, "mt-").otherwise("g"), F.col("gene_idx").cast("string"))
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey", "l_quantity")
        .repartition("l_orderkey")
        .groupBy(F.col("l_orderkey").alias("gid"), F.col("l_partkey").alias("gene_idx"))
        .agg(F.sum("l_quantity").alias("value"))
        .select("gid", (F.col("gid") % 10).cast("int").alias("slice_idx"), "gene_idx", gene.alias("gene"), "value")
    )


def count_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots of the sparse expression: (gid, slice_idx, x, y); coordinates lie on a lattice, so equal distances are common."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_orderkey").alias("gid"))
        .distinct()
        .select(
            "gid",
            (F.col("gid") % 10).cast("int").alias("slice_idx"),
            (((F.col("gid") * 7919) % 10007) / F.lit(100.0)).alias("x"),
            (((F.col("gid") * 104729) % 10009) / F.lit(100.0)).alias("y"),
        )
    )


def pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, p) for the multiple-testing operators."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("gene"), (F.col("value") / 500.0).alias("p"))


#: DuckDB common table expressions for the same views.
SQL = {
    "spots": """spots as (select vec_id as gid, label as slice_idx, 'S' || lpad(cast(label as varchar), 2, '0') as slice_id,
  10 * cast(embedding[1] as double) as x, 10 * cast(embedding[2] as double) as y, cast(embedding as double[]) as vec from embeddings)""",
    "counts": """counts as (select l_orderkey as gid, cast(l_orderkey % 10 as int) as slice_idx, l_partkey as gene_idx,
  (case when l_partkey % 50 = 0 then 'mt-' else 'g' end) || cast(l_partkey as varchar) as gene, sum(l_quantity) as value
  from lineitem group by all)""",
    "cspots": """cspots as (select distinct l_orderkey as gid, cast(l_orderkey % 10 as int) as slice_idx,
  ((l_orderkey * 7919) % 10007) / 100.0::double as x, ((l_orderkey * 104729) % 10009) / 100.0::double as y from lineitem)""",
    "pvalues": "pvalues as (select event_id as gene, value / 500.0::double as p from events)",
}


def sql(*names: str, then: str) -> str:
    """An oracle: the named views, then further tables and the final select."""
    return "with " + ",\n".join([*(SQL.get(n, n) for n in names)]) + "\n" + then
