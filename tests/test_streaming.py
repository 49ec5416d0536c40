"""Slices of a stream are counted and registered like those of a batch."""

import math

import numpy as np

from slabwise.operators import registration
from slabwise.session import ship
from slabwise.streaming import incremental


def test_new_slices_are_registered(spark, tmp_path):
    ship(spark)
    rng = np.random.default_rng(0)
    xy, x = rng.normal(size=(30, 2)) * 5, rng.normal(size=(30, 8))
    schema = "gid long, slice_idx int, x double, y double, vec array<double>"
    for k, angle in ((1, 20), (2, -35)):
        moved = xy @ registration.rotation(math.radians(angle)).T + k
        spark.createDataFrame([(100 * k + i, k, *map(float, moved[i]), x[i].tolist()) for i in range(30)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    anchor = registration.Block(np.arange(30), xy, x)
    options = registration.Options(subsample_n=30, expr_knn=None)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.register_stream(stream, anchor, options, str(tmp_path / "poses"), str(tmp_path / "state")).awaitTermination(120)
    got = {r.slice_idx: r for r in spark.read.parquet(str(tmp_path / "poses")).collect()}
    assert abs(math.degrees(got[1].theta) + 20) < 1e-3 and abs(math.degrees(got[2].theta) - 35) < 1e-3
    q = incremental.slice_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.slice_idx, r.n_obs) for r in spark.sql("select * from counts").collect()} == {(1, 30), (2, 30)}
