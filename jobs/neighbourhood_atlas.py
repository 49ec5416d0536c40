"""Batch job: the neighbourhood atlas of a stack of slices.

Reads a table of spots, leaves out rows that cannot be placed, builds the weighted
three-dimensional neighbour graph, and writes under the output folder

* edges/slice_idx=...: (src, dst, w), by the source's slice
* spots/slice_idx=...: (gid, x, y, z, n_neighbours, strength, across), where across is the
  strength of edges to other slices
* report: a line of JSON for each slice

    python -m jobs.neighbourhood_atlas --input spots.parquet --output atlas

The config names the columns as SQL expressions of the input. With `slices`, only those
slices' partitions and report lines are made anew; the graph still sees their neighbours.
Every run replaces the partitions that it writes, so a run that is repeated, or was cut
short before, ends with the same content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slabwise.model import Cube
from slabwise.operators import graph
from slabwise.session import cut, ship

from .common import command_line, load_config, log, replace_partitions, selected

NAME = "neighbourhood_atlas"

SPOTS = "gid long, x double, y double, z double, n_neighbours long, strength double, across double, slice_idx int"


def placeable(rows: DataFrame) -> DataFrame:
    """Rows with an id, a slice and finite coordinates; of rows that share an id the one of least slice and coordinates."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    sound = rows.filter(F.col("gid").isNotNull() & F.col("slice_idx").isNotNull() & finite("x") & finite("y"))
    return sound.groupBy("gid").agg(F.min(F.struct("slice_idx", "x", "y")).alias("s")).select("gid", "s.*")


def run(spark: SparkSession, input: str, output: str, config: dict | None = None) -> dict:
    """Read `input`, write the atlas under `output`, and return what was read and written."""
    ship(spark)
    config = load_config(NAME) | (config or {})
    rows = selected(spark.read.parquet(input), config["columns"])
    n_read = rows.count()
    spots = cut(placeable(rows))
    cube = Cube(spots, lambda_z=config["lambda_z"], z_base=config["z_base"], z_spacing=config["z_spacing"])
    n_used = spots.count()
    log.info("%s: read %d rows of %s, %d can be placed", NAME, n_read, input, n_used)
    asked = cube.slices()
    if config["slices"] is not None:
        asked = asked.filter(F.col("slice_idx").isin([int(s) for s in config["slices"]]))
    asked = asked.select("slice_idx", "z")
    near = set(r["slice_idx"] + step for r in asked.collect() for step in (-2, -1, 0, 1, 2))  # a row for each slice
    # an edge's weight takes the spots of both its slices and the bandwidth of the pair, which the next slice's spots share
    around = spots if config["slices"] is None else spots.filter(F.col("slice_idx").isin(sorted(near)))
    edges = graph.weighted_graph(around, config["n_intra"], config["n_inter"], lambda_z=config["lambda_z"], z_spacing=config["z_spacing"])
    at = lambda c: spots.select(F.col("gid").alias(c), F.col("slice_idx").alias(f"{c}_slice"))
    own = edges.join(at("src"), "src").join(F.broadcast(asked.select(F.col("slice_idx").alias("src_slice"))), "src_slice")
    placed = cut(own.join(at("dst"), "dst").select("src", "dst", "w", F.col("src_slice").alias("slice_idx"), (F.col("src_slice") != F.col("dst_slice")).alias("leaves")))
    replace_partitions(placed.select("src", "dst", "w", "slice_idx").repartition("slice_idx", F.pmod(F.xxhash64("src"), F.lit(16))), f"{output}/edges", "slice_idx")
    sums = placed.groupBy(F.col("src").alias("gid")).agg(F.count("*").alias("n_neighbours"), F.sum("w").alias("strength"), F.sum(F.when(F.col("leaves"), F.col("w")).otherwise(0.0)).alias("across"))
    whole = spots.join(F.broadcast(asked), "slice_idx").join(sums, "gid", "left").fillna(0, ["n_neighbours", "strength", "across"])  # a row for each slice
    whole = cut(whole.select("gid", "x", "y", "z", "n_neighbours", "strength", "across", "slice_idx"))
    replace_partitions(whole.repartition("slice_idx", F.pmod(F.xxhash64("gid"), F.lit(16))), f"{output}/spots", "slice_idx")
    report = whole.groupBy("slice_idx").agg(F.count("*").alias("spots"), F.sum("n_neighbours").alias("edges"), F.sum("strength").alias("strength"), F.sum("across").alias("across"))
    report.withColumn("slice", F.col("slice_idx")).repartition("slice_idx").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice_idx").json(f"{output}/report")
    wrote = {"read": n_read, "spots": whole.count(), "edges": placed.count(), "slices": asked.count()}
    log.info("%s: wrote %d spots and %d edges of %d slices to %s", NAME, wrote["spots"], wrote["edges"], wrote["slices"], output)
    return wrote


def result(spark: SparkSession, output: str) -> DataFrame:
    """The spots of the atlas as they stand."""
    return spark.read.schema(SPOTS).parquet(f"{output}/spots")


if __name__ == "__main__":
    args = command_line(__doc__.splitlines()[0], "input", "output")
    session = SparkSession.builder.appName(NAME).getOrCreate()
    try:
        run(session, args.input, args.output, load_config(NAME, args.config))
    finally:
        session.stop()
