"""Linear algebra over rows: Gram matrices and truncated SVD, smoothing, sparse products, diffusion."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabwise.functions.arrays import dot, element_sums
from slabwise.functions.blocks import list_array, rows_of
from slabwise.session import cut

from . import blocked, graph, neighbors

#: Dimensions up to which X^T X is made (8 bytes for each pair of them on the driver); beyond, subspace iteration on X itself.
MOST_GRAM = 1024

#: Columns of a sparse matrix up to which its products are taken by whole rows; beyond, by joins.
MOST_COLUMNS = 16_384

#: Places of a vector that one grouped pass adds up.
PLACES = 64


def gram_matrix(features: DataFrame) -> np.ndarray:
    """X^T X on the driver, d x d: blocks of rows are multiplied in tasks and the products added up. For d up to MOST_GRAM."""

    def multiply(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch.column(0))
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), list_array(total)], names=["i", "row"])

    products = features.select("vec").mapInArrow(multiply, "i int, row array<double>")
    sums = products.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j = sums.column("i").to_numpy(), sums.column("j").to_numpy()
    out = np.zeros((1 + i.max(initial=-1),) * 2)
    out[i, j] = sums.column("v").to_numpy()
    return out


def components(g: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (columns) and singular values of X from its Gram matrix, not centred; signs by the greatest component."""
    if not g.size:
        return np.zeros((0, 0)), np.zeros(0)
    dim = max(1, min(dim, len(g) - 1)) if len(g) > 1 else 1
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(-values)[:dim]
    v = vectors[:, order]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return v, np.sqrt(np.maximum(values[order], 0))


def project(features: DataFrame, basis: np.ndarray) -> DataFrame:
    """features with vec replaced by vec·basis, in Arrow batches; the basis, d x dim numbers, is broadcast."""
    shared = features.sparkSession.sparkContext.broadcast(basis)
    at, schema = features.columns.index("vec"), features.schema

    def multiply(batches):
        for batch in batches:
            x = rows_of(batch.column(at)) @ shared.value if batch.num_rows else np.zeros((0, 1))
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([vec if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return features.withColumn("vec", F.col("vec").cast("array<double>")).mapInArrow(multiply, schema)


def _signed(v: np.ndarray) -> np.ndarray:
    return v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])


def _orthonormal(g: np.ndarray) -> np.ndarray:
    """The matrix M for which Y M has orthonormal columns, of Y's Gram matrix; directions that Y lacks become 0."""
    values, vectors = np.linalg.eigh(g)
    keep = values > 1e-12 * max(values.max(initial=0.0), 1e-300)
    return vectors * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1.0)), 0.0)


def sparse_svd(entries: DataFrame, dim: int, rounds: int = 6, spare: int = 10, seed: int = 0) -> DataFrame:
    """Truncated SVD, not centred, of the sparse matrix (gid, gene_idx, value): (gid, vec), vec being the row's U·S.

    Randomised subspace iteration with dim + spare numbers for each column. Up to MOST_COLUMNS columns
    each row's entries are written once, side by side; a round is one pass over them that hands on
    sums of the columns' size, and no vector of a row is written. With more columns, rows and columns are
    multiplied by joins and grouped sums, and the driver sees matrices of dim + spare numbers a side alone.
    Rows without entries have no row in the result.
    """
    columns = entries.select("gene_idx").distinct().filter("gene_idx is not null").limit(MOST_COLUMNS + 1).count()
    if columns <= MOST_COLUMNS:
        return _svd_by_rows(entries, dim, rounds, spare, seed)
    return _svd_by_joins(entries, dim, rounds, spare, seed)


def _start(columns: DataFrame, width: int, seed: int) -> DataFrame:
    """(gene_idx, vec): what the iteration begins with."""
    uniform = [(F.pmod(F.xxhash64("gene_idx", F.lit(seed), F.lit(i)), F.lit(2_000_003)) - 1_000_001).cast("double") for i in range(width)]
    return columns.select("gene_idx", F.array(*uniform).alias("vec"))


def _svd_by_rows(entries: DataFrame, dim: int, rounds: int, spare: int, seed: int) -> DataFrame:
    """sparse_svd of few columns: the driver holds columns x (dim + spare) numbers, a task these and a batch of rows."""
    spark, width, kind = entries.sparkSession, dim + spare, entries.schema["gid"].dataType.simpleString()
    start = _start(cut(entries.select("gene_idx").distinct().filter("gene_idx is not null")), width, seed).orderBy("gene_idx").toArrow()  # a row for each column
    if not start.num_rows:
        return spark.createDataFrame([], f"gid {kind}, vec array<double>")
    v = rows_of(start.column("vec").combine_chunks())
    genes = pa.table({"gene_idx": start.column("gene_idx"), "at": pa.array(np.arange(len(v)), pa.int32())})
    placed = entries.join(F.broadcast(spark.createDataFrame(genes)), "gene_idx").select("gid", F.struct("at", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("v")).alias("e"))
    rows = cut(placed.groupBy("gid").agg(F.collect_list("e").alias("e")).select("gid", F.col("e.at").alias("at"), F.col("e.v").alias("v")))

    def products(batch, basis):
        """Places, values and rows of a batch's entries, and the rows' products with the basis."""
        at, val = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("at", "v"))
        n = batch.column("at").value_lengths().to_numpy(zero_copy_only=False)
        return at, val, np.repeat(np.arange(len(n)), n), np.add.reduceat(val[:, None] * basis[at], np.cumsum(n) - n, axis=0)

    def twice(basis):
        """A^T A times the basis."""
        shared = spark.sparkContext.broadcast(basis)

        def multiply(batches):
            total = np.zeros(shared.value.shape)
            for batch in batches:
                if batch.num_rows:
                    at, val, row, y = products(batch, shared.value)
                    for c in range(total.shape[1]):
                        total[:, c] += np.bincount(at, val * y[row, c], len(total))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), list_array(total)], names=["i", "vec"])

        sums = mean_vector(rows.select("at", "v").mapInArrow(multiply, "i int, vec array<double>").withColumn("one", F.lit(1.0)), ["i"], weight="one", width=width)
        return rows_of(sums.orderBy("i").toArrow().column("vec").combine_chunks())

    v = v @ _orthonormal(v.T @ v)
    for _ in range(rounds):
        w = twice(v)
        w = w @ _orthonormal(v.T @ w)  # v^T A^T A v is the Gram matrix of the rows' products
        v = w @ _orthonormal(w.T @ w)
    values, turn = np.linalg.eigh(v.T @ twice(v))
    shared = spark.sparkContext.broadcast(v @ _signed(turn[:, np.argsort(-values)[: min(dim, width)]]))

    def project_rows(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("gid"), list_array(products(batch, shared.value)[3])], names=["gid", "vec"])

    return rows.mapInArrow(project_rows, f"gid {kind}, vec array<double>")


def _svd_by_joins(entries: DataFrame, dim: int, rounds: int, spare: int, seed: int) -> DataFrame:
    width = dim + spare
    entries = cut(entries.select("gid", "gene_idx", F.col("value").cast("double").alias("value")))
    v = cut(_start(entries.select("gene_idx").distinct(), width, seed))

    def times(vectors, on, by):
        return cut(mean_vector(entries.join(vectors, on).select(by, "value", "vec"), [by], weight="value", width=width))

    def orthonormal(vectors):
        return project(vectors, _orthonormal(gram_matrix(vectors)))

    v = orthonormal(v)
    for _ in range(rounds):
        v = orthonormal(times(orthonormal(times(v, "gene_idx", "gid")), "gid", "gene_idx"))
    rows = times(v, "gene_idx", "gid")
    values, turn = np.linalg.eigh(gram_matrix(rows))
    return project(rows, _signed(turn[:, np.argsort(-values)[: min(dim, width)]]))


def _wide_basis(features: DataFrame, dim: int, rounds: int = 8, spare: int = 10) -> np.ndarray:
    """Right singular vectors of wide dense rows by subspace iteration: d x dim numbers on the driver, never d x d."""
    d = features.select(F.size("vec").alias("d")).first()["d"]
    width = min(d, dim + spare)
    q, _ = np.linalg.qr(np.random.default_rng(0).normal(size=(d, width)))
    for _ in range(rounds):
        shared = features.sparkSession.sparkContext.broadcast(q)

        def multiply(batches, shared=shared):
            total = 0.0
            for batch in batches:
                if batch.num_rows:
                    x = rows_of(batch.column(0))
                    total = total + x.T @ (x @ shared.value)
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * total.shape[1], pa.int32()), pa.array(total.ravel()))], names=["i", "vec"])

        parts = features.select("vec").mapInArrow(multiply, "i int, vec array<double>")
        found = mean_vector(parts, ["i"], weight=None, width=width).orderBy("i").toArrow()
        q, _ = np.linalg.qr(rows_of(found.column("vec").combine_chunks()))
    values, turn = np.linalg.eigh(gram_matrix(project(features.select("vec"), q)))
    return _signed(q @ turn[:, np.argsort(-values)[:dim]])


def svd_embedding(features: DataFrame, dim: int = 50, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Truncated SVD fitted on at most `sample` rows of each slice, applied to all rows: (gid, slice_idx, vec)."""
    fitted = neighbors.subsample(features, sample, seed) if sample else features
    rows = features.select("gid", "slice_idx", F.col("vec").cast("array<double>").alias("vec"))
    first = fitted.select(F.size("vec").alias("d")).first()
    if not first or not first["d"]:
        return rows
    basis = components(gram_matrix(fitted), dim)[0] if first["d"] <= MOST_GRAM else _wide_basis(cut(fitted.select("vec")), min(dim, first["d"] - 1))
    return project(rows, basis)


def sparse_embedding(spots: DataFrame, entries: DataFrame, dim: int = 50, **options) -> DataFrame:
    """Features of spots (gid, slice_idx) from their sparse counts (gid, gene_idx, value): (gid, slice_idx, vec), zeros for a spot without counts."""
    found = sparse_svd(entries.join(spots.select("gid"), "gid", "left_semi"), dim, **options)
    return spots.select("gid", "slice_idx").join(found, "gid", "left").select("gid", "slice_idx", F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)).alias("vec"))


def mean_vector(rows: DataFrame, by: list[str], vec: str = "vec", weight: str | None = None, width: int | None = None) -> DataFrame:
    """Weighted element-wise sums (or means without a weight) of an array column by group: (by, vec).

    Vectors are added up within each task before the shuffle, PLACES of them in one row;
    longer ones are first cut into pieces of that length. All have `width` places.
    """
    if width is None:
        first = rows.select(F.size(vec).alias("d")).first()
        width = first["d"] if first else 0
    w = F.col(weight) if weight else None
    n = min(width, PLACES)
    value = F.array(*(F.coalesce(F.col(f"_{i}"), F.lit(0.0)) if weight else F.coalesce(F.col(f"_{i}"), F.lit(0.0)) / F.col("__n") for i in range(n)))
    if width <= PLACES:
        return rows.groupBy(*by).agg(F.count("*").alias("__n"), *element_sums(vec, n, w)).select(*by, value.cast("array<double>").alias("vec"))
    piece = F.slice(F.col(vec), F.col("__p") * PLACES + 1, F.lit(PLACES))
    parts = rows.withColumn("__p", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(width / PLACES) - 1)))).withColumn("__v", piece)
    sums = parts.groupBy(*by, "__p").agg(F.count("*").alias("__n"), *element_sums("__v", n, w)).select(*by, "__p", value.alias("v"))
    packed = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__p", "v"))).alias("p"))
    return packed.select(*by, F.slice(F.flatten(F.transform("p", lambda p: p["v"])), 1, width).alias("vec"))


def smooth(features: DataFrame, spots: DataFrame, k: int = 15, alpha: float = 0.7, steps: int = 2) -> DataFrame:
    """E <- (1 - alpha) E0 + alpha * (mean of the spatial neighbours' E), `steps` times: (gid, slice_idx, vec)."""
    near = cut(neighbors.knn_within(spots, max(3, k)).select("src", "dst", F.lit(1.0).alias("w")))
    first = cut(features.select("gid", "slice_idx", "vec"))
    matrix = blocked.BlockedMatrix(near, blocked.places_of_spots(spots))
    fixed, now = matrix.fixed(first), matrix.vectors(first)
    for _ in range(max(1, steps)):
        now = cut(matrix.times(now, fixed, (1 - alpha, alpha, 1.0), mean=True))
    return first.select("gid", "slice_idx").join(now.select("gid", "vec"), "gid")


def sparse_product(edges: DataFrame, vectors: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """A·Z for edges (src, dst, w) and rows (gid, vec): (gid, vec). places (gid, block) says which nodes stand together."""
    edges = cut(edges.select("src", "dst", "w"))
    return blocked.BlockedMatrix(edges, places_of(edges, vectors) if places is None else places).product(vectors)


def places_of(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(gid, block) of all nodes, by their ids: for graphs without coordinates."""
    return blocked.places_of_ids(edges.select(F.col("src").alias("gid")).union(edges.select("dst")).union(vectors.select("gid")))


def frobenius(rows: DataFrame) -> DataFrame:
    return rows.agg(F.sqrt(F.sum(dot("vec", "vec"))).alias("norm"))


def diffuse(
    edges: DataFrame, features: DataFrame, eta: float = 0.5, steps: int = 50, tol: float = 1e-6, eps: float = 1e-12, places: DataFrame | None = None
) -> DataFrame:
    """Personalised diffusion Z <- (1 - eta) X + eta A Z of rows (gid, vec), A row-normalised, until Z changes by less than tol."""
    if not 0 < eta < 1:
        raise ValueError("eta must lie between 0 and 1")
    a = cut(graph.row_normalised(edges, eps))
    x = cut(features.select("gid", "vec"))
    matrix = blocked.BlockedMatrix(a, places_of(a, x) if places is None else places)
    fixed, z = matrix.fixed(x), matrix.vectors(x)
    for _ in range(steps):
        z = cut(matrix.times(z, fixed, (1 - eta, eta, 1 - eta)))
        if not tol:
            continue  # all steps are wanted
        row = z.agg(F.sum("change").alias("d"), F.sum("size").alias("n")).first()
        if not row["d"] or np.sqrt(row["d"]) / (np.sqrt(row["n"]) + eps) < tol:
            break
    return z.select("gid", "vec")
