"""Session helpers: the shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir.

    A folder of our own is set only where none is named and the master runs in
    this one process (tests); on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="slabwise-checkpoints-")
    sc.setCheckpointDir(named)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or the session's checkpoint folder where none is named."""
    ensure_checkpoint_dir(spark)
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.sparkContext.getCheckpointDir()).rstrip("/")


#: Rows and bytes of an Arrow batch, where the session has Spark's defaults: beside each batch its task holds two or three copies.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def bound_batches(spark: SparkSession) -> None:
    """Set ARROW_BATCH for what the session, or its cluster, has not set itself."""
    if getattr(spark, "_slabwise_batches", False):
        return
    named = spark.sparkContext.getConf()
    for key, value in ARROW_BATCH.items():
        if not named.contains(key):
            spark.conf.set(key, value)
    spark._slabwise_batches = True


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound their batches: call it once for a session.

    Nothing is done where PYTHONPATH already names the package's folder. In one
    process workers get that folder; on a cluster they get a zip file of the package.
    """
    bound_batches(spark)
    root, sc = Path(__file__).resolve().parents[1], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_slabwise_shipped", False):
        return
    if sc.master == "local" or sc.master.startswith("local["):
        sc.environment["PYTHONPATH"] = ":".join(x for x in (str(root), sc.environment.get("PYTHONPATH", "")) if x)
    else:
        to = Path(tempfile.mkdtemp(prefix="slabwise-ship-")) / "slabwise.zip"
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted((root / "slabwise").rglob("*.py")):
                z.write(f, f.relative_to(root))
        sc.addPyFile(str(to))
    sc._slabwise_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, *by: str) -> DataFrame:
    """df as a table in the shared folder, for joins that are repeated many times on their own results; by: its partitions.

    A checkpoint keeps the size that was estimated for its plan, and estimates of joins
    multiply: after some rounds the estimate alone takes the driver seconds. A table has its files' size.
    """
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
