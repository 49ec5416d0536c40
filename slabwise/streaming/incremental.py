"""Slices that arrive as a stream: counts by slice, and registration of each new slice to a fixed anchor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabwise.operators import neighbors, registration


def slice_counts(stream: DataFrame) -> DataFrame:
    """Running (slice_idx, n_obs, min_x, max_x, min_y, max_y) of a stream of spots, for update or complete output."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)]
    return stream.groupBy("slice_idx").agg(F.count("*").alias("n_obs"), *ends)


def register_batch(batch: DataFrame, anchor: registration.Block, options: registration.Options) -> DataFrame:
    """Poses of the slices of a batch of (gid, slice_idx, x, y, vec) against a bounded anchor block, a task for each slice."""
    import numpy as np
    import pandas as pd

    shared = batch.sparkSession.sparkContext.broadcast(anchor)
    names = ["slice_idx", "theta", "s", "dx", "dy", "chamfer", "method"]

    def one(pdf):
        pdf = pdf.sort_values("gid")
        src = registration.Block(pdf["gid"].to_numpy(), pdf[["x", "y"]].to_numpy(float), np.array(pdf["vec"].tolist(), dtype=float))
        s, r, t, far, name = registration.register(src, shared.value, options)
        return pd.DataFrame([(int(pdf["slice_idx"].iloc[0]), float(np.arctan2(r[1, 0], r[0, 0])), float(s), float(t[0]), float(t[1]), far, name)], columns=names)

    picked = neighbors.subsample(batch, options.subsample_n, options.random_state)
    return picked.groupBy("slice_idx").applyInPandas(one, "slice_idx int, theta double, s double, dx double, dy double, chamfer double, method string")


def register_stream(stream: DataFrame, anchor: registration.Block, options: registration.Options, path: str, checkpoint: str):
    """Start a query that registers each micro-batch's slices and keeps their poses under path.

    A batch is written to a folder of its number, so a batch that is run again after a
    failure replaces what it wrote. Slices are expected whole within a batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        register_batch(batch, anchor, options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
