"""Incremental job: count profiles of slices whose units are texts.

Each text is a unit of its slice and each different word a feature, as spots and genes
are elsewhere. The job takes the files of the input that it has not seen, counts them,
and keeps under the output folder

* counts/batch=...: (slice, feature, n_units, total) of each micro-batch
* profiles/slice=...: (feature, n_units, total, n_slices, place) of all batches together:
  features that pass the filters, in how many slices they do, and their place by total
  if it is among the first `top` of the slice

    python -m jobs.word_profiles --input texts/ --output profiles --checkpoint state/

What has been taken stands in the checkpoint of the stream of files. A micro-batch that is
run again after a failure replaces its own partition, and profiles are always the sum of
all partitions, so each file counts once however often the job is started. Files are
added to the input, never changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from slabwise.operators import svg
from slabwise.session import cut

from .common import command_line, load_config, log, read_or_empty, replace_partitions, selected, watched

NAME = "word_profiles"

COUNTS = "slice string, feature string, n_units long, total long, batch long"
PROFILES = "feature string, n_units long, total long, n_slices long, place int, slice string"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted(texts: DataFrame, word: str) -> DataFrame:
    """(slice, feature, n_units, total) of (slice, text): units that hold the word, and how often they do.

    Both counts are added up in one pass, within the tasks first: a word adds to the
    total each time, and once more as one of its text's different words to the units.
    """
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), F.lit(word), F.lit(0))
    seen = lambda arr, units, total: F.transform(arr, lambda w: F.struct(w.alias("feature"), F.lit(units).alias("n_units"), F.lit(total).alias("total")))
    both = texts.select("slice", words.alias("w")).select("slice", F.explode(F.concat(seen("w", 0, 1), seen(F.array_distinct("w"), 1, 0))).alias("e"))
    return both.select("slice", "e.*").groupBy("slice", "feature").agg(F.sum("n_units").cast("long").alias("n_units"), F.sum("total").cast("long").alias("total"))


def profiled(counts: DataFrame, config: dict) -> DataFrame:
    """Profiles of the sums of all batches' counts."""
    sums = counts.groupBy("slice", "feature").agg(F.sum("n_units").alias("n_units"), F.sum("total").alias("total"))
    kept = svg.without_prefixes(sums.filter((F.col("n_units") >= config["least_units"]) & (F.col("total") >= config["least_total"])).withColumnRenamed("feature", "gene"), tuple(config["exclude"]))
    kept = cut(kept.withColumnRenamed("gene", "feature"))
    shared = svg.presence(kept.select(F.col("slice").alias("slice_idx"), F.col("feature").alias("gene")), config["least_slices"]).select(F.col("gene").alias("feature"), F.col("slices").alias("n_slices"))
    first = Window.partitionBy("slice").orderBy(F.desc("total"), "feature")
    places = kept.select("slice", "feature", F.row_number().over(first).alias("place"), F.lit(1).alias("one")).filter(F.col("place") <= config["top"]).drop("one")
    return kept.join(shared, "feature", "left").join(F.broadcast(places), ["slice", "feature"], "left").select("feature", "n_units", "total", F.coalesce("n_slices", F.lit(0)).cast("long").alias("n_slices"), "place", "slice")  # `top` rows for each slice


def run(spark: SparkSession, input: str, output: str, checkpoint: str, config: dict | None = None) -> dict:
    """Count the files of `input` that are new to `checkpoint`, and bring the profiles under `output` up to date."""
    config = load_config(NAME) | (config or {})

    def take(batch: DataFrame, number: int) -> None:
        replace_partitions(counted(selected(batch, config["columns"]), config["word"]).withColumn("batch", F.lit(number)), f"{output}/counts", "batch")

    stream = spark.readStream.schema(spark.read.parquet(input).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(watched(input))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    steps = [p for p in query.recentProgress if p["numInputRows"]]
    n_read = sum(p["numInputRows"] for p in steps)
    log.info("%s: read %d new rows of %s in %d batches", NAME, n_read, input, len(steps))
    profiles = cut(profiled(read_or_empty(spark, f"{output}/counts", COUNTS), config))
    replace_partitions(profiles.repartition("slice", F.pmod(F.xxhash64("feature"), F.lit(4))), f"{output}/profiles", "slice")
    wrote = {"read": n_read, "batches": len(steps), "profiles": profiles.count(), "slices": profiles.select("slice").distinct().count()}
    log.info("%s: wrote %d features of %d slices to %s", NAME, wrote["profiles"], wrote["slices"], output)
    return wrote


def result(spark: SparkSession, output: str) -> DataFrame:
    """The profiles as they stand; a slice without a name was an empty string."""
    return read_or_empty(spark, f"{output}/profiles", PROFILES).withColumn("slice", F.coalesce("slice", F.lit("")))


if __name__ == "__main__":
    args = command_line(__doc__.splitlines()[0], "input", "output", "checkpoint")
    session = SparkSession.builder.appName(NAME).getOrCreate()
    try:
        run(session, args.input, args.output, args.checkpoint, load_config(NAME, args.config))
    finally:
        session.stop()
