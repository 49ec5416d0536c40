"""Readers and writers of merged tables, sparse matrices, gene lists and coordinates."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slabwise.model import SpatialKeys, require_columns
from slabwise.operators.ranking import numbered
from slabwise.session import ship
from slabwise.sources import formats


def read_merged(spark: SparkSession, path: str | None = None, env_key: str = "SLABWISE_DATA", keys: SpatialKeys = SpatialKeys(), ensure_spatial: bool = True) -> DataFrame:
    """A merged spot table, Parquet by default; the path falls back to an environment variable. x and y are derived where absent."""
    path = path or os.environ.get(env_key)
    if not path:
        raise ValueError(f"give a path or set {env_key}")
    df = read_h5ad(spark, path) if path.endswith(".h5ad") else spark.read.parquet(path)
    return derive_xy(df, keys) if ensure_spatial else df


def derive_xy(df: DataFrame, keys: SpatialKeys = SpatialKeys(), overwrite: bool = False) -> DataFrame:
    if {"x", "y"} <= set(df.columns) and not overwrite:
        return df
    require_columns(df, [keys.x_key, keys.y_key])
    return df.withColumns({"x": F.col(keys.x_key).cast("double"), "y": F.col(keys.y_key).cast("double")})


def read_h5ad(spark: SparkSession, path: str) -> DataFrame:
    """Spot attributes (obs) of an annotated-matrix file that all executors can open, with x and y from obsm/spatial, read by ranges of rows; h5py is optional."""
    return _known(spark).read.format("h5ad").load(path)


def read_h5ad_matrix(spark: SparkSession, path: str, rows: int = 10_000) -> DataFrame:
    """(gid, gene_idx, gene, value): the non-zero entries of X, dense or compressed by rows, gid being the row's place.

    Tasks read `rows` rows each, so the path must be one that all executors can open.
    """
    with formats.h5(path) as f:
        x = f["X"]
        n = (len(x["indptr"]) - 1) if hasattr(x, "items") else x.shape[0]
        index = f["var"].attrs.get("_index", "_index")
        genes = [str(g) for g in formats.strings(f["var"][index])]
        if hasattr(x, "items") and "csc" in str(x.attrs.get("encoding-type", "csr_matrix")):
            raise ValueError("X is compressed by columns: store it by rows")
    shared = spark.sparkContext.broadcast(genes)  # a name for each gene

    def entries(batches):
        with formats.h5(path) as f:
            x = f["X"]
            for batch in batches:
                for low in batch.column(0).to_pylist():
                    if hasattr(x, "items"):
                        ends = x["indptr"][low : min(low + rows, n) + 1]
                        gene, value = x["indices"][ends[0] : ends[-1]], x["data"][ends[0] : ends[-1]]
                        row = np.repeat(np.arange(low, low + len(ends) - 1), np.diff(ends))
                    else:
                        part = x[low : low + rows]
                        row, gene = np.nonzero(part)
                        row, value = row + low, part[row, gene]
                    names = shared.value
                    yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(gene, pa.int64()), pa.array([names[g] for g in gene], pa.string()), pa.array(np.asarray(value, float))], names=["gid", "gene_idx", "gene", "value"])

    starts = spark.range(0, n, rows, max(1, -(-n // rows)))
    return starts.mapInArrow(entries, "gid long, gene_idx long, gene string, value double").filter("value <> 0")


def _known(spark: SparkSession) -> SparkSession:
    ship(spark)
    formats.register(spark)
    return spark


def write_matrix(counts: DataFrame, path: str) -> None:
    """(gid, gene_idx, value) as one Matrix Market file of rows `gene spot value` with dense numbers from 1, by the format `mtx`."""
    genes, spots = numbered(counts.select("gene_idx").distinct(), ["gene_idx"], "g", 1), numbered(counts.select("gid").distinct(), ["gid"], "s", 1)
    rows = counts.join(genes, "gene_idx").join(spots, "gid").select("g", "s", F.col("value").cast("double").alias("value"))
    _known(counts.sparkSession)
    rows.write.format("mtx").mode("overwrite").save(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(g, s, value) of a Matrix Market coordinate file: real, integer or pattern (value 1), general or symmetric (both halves are returned). A ValueError for files of another kind."""
    formats.checked(path)
    return _known(spark).read.format("mtx").load(path)


def write_genes(genes: DataFrame, path: str, column: str = "gene") -> None:
    genes.select(column).orderBy(column).write.mode("overwrite").text(path)


def write_coordinates(spots: DataFrame, path: str) -> None:
    spots.select("gid", "x", "y").write.mode("overwrite").csv(path, header=True)


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="gid long, x double, y double")


def read_results(spark: SparkSession, path: str, schema: str = "gene string, combinedPval double, adjustedPval double", genes: DataFrame | None = None) -> DataFrame:
    """A table of test results; with genes, one row for each of them is demanded.

    A ValueError where the header lacks a column of the schema, and where rows are
    missing, repeated or of genes that were not tested.
    """
    header = spark.read.csv(path, header=True).columns
    names = [f.split()[0] for f in schema.split(", ")]
    if lost := [c for c in names if c not in header]:
        raise ValueError(f"{path} lacks the columns {lost}")
    rows = spark.read.csv(path, header=True, enforceSchema=False, schema=", ".join(f"`{c}` {dict(f.split() for f in schema.split(', ')).get(c, 'string')}" for c in header)).select(*names)
    if genes is not None:
        key = names[0]
        met = rows.groupBy(key).count().join(genes.select(F.col(genes.columns[0]).alias(key)).withColumn("known", F.lit(True)), key, "full")
        bad = met.filter("count is null or known is null or count > 1").limit(5).collect()
        if bad:
            raise ValueError(f"{path} and the genes tested differ, among others in {[r[key] for r in bad]}")
    return rows
