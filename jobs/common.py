"""What the jobs share: configs, checked input, and reading back what was written."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def load_config(name: str, given: str | None = None) -> dict:
    """The config file of that name beside the jobs, with the values of another one put over it."""
    config = json.loads((Path(__file__).parent / f"{name}.json").read_text())
    return config | (json.loads(Path(given).read_text()) if given else {})


def selected(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns, each a SQL expression of the input's."""
    return df.select(*(F.expr(e).alias(n) for n, e in columns.items()))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet folder of a known schema, without rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Write df so that it replaces the partitions it has rows of and leaves the others: a rerun gives the same files' content."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def watched(path: str) -> str:
    """The path of a file or a folder as a pattern that only it fits, as streams of files take single files by pattern alone."""
    bare = path.rstrip("/")
    return bare if any(c in bare for c in "*?[{") else f"{bare[:-1]}[{bare[-1]}]"


def command_line(description: str, *paths: str) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=description)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", help="a JSON file whose values replace those of the job's own config")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return parser.parse_args()
