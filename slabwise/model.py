"""Schemas, configuration and the guards of the public calls."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slabwise.operators.ranking import numbered


@dataclass(frozen=True)
class SpatialKeys:
    """Columns from which coordinates are derived."""

    x_key: str = "coor_x_ad2"
    y_key: str = "coor_y_ad2"


@dataclass(frozen=True)
class OrderConfig:
    subsample_n: int = 2000
    svd_dim: int = 50
    knn: int = 30
    use_ot: bool = True
    ot_reg: float = 0.05
    random_state: int = 0
    canonical_direction: bool = False


@dataclass(frozen=True)
class ContrastiveConfig:
    svd_dim: int = 50
    embed_dim: int = 32
    hidden_dim: int = 128
    lr: float = 1e-3
    weight_decay: float = 1e-4
    temperature: float = 0.2
    epochs: int = 50
    batch_size: int = 4096
    random_state: int = 0
    #: Batches of an epoch, a task for each; their gradients' mean makes one step.
    parallel: int = 1


@dataclass(frozen=True)
class AlignResult:
    chamfer_xy: float
    n_source: int
    n_target: int
    method: str


@dataclass(frozen=True)
class SliceInfo:
    key: str
    z: float
    n_obs: int
    extra: dict = field(default_factory=dict)


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")


def spots_from(
    df: DataFrame, slice_col: str, row_id: str | Column, keys: SpatialKeys = SpatialKeys(), sort: str = "lexicographic", order: list[str] | None = None
) -> DataFrame:
    """Spots of a merged table: (gid, slice_idx, slice_id, spot_idx, x, y, x_raw, y_raw) and the table's other columns.

    Slices are numbered by their id as text (a null id is the slice 'nan'), or in the
    given order; spots within a slice by row_id. The raw coordinates are a snapshot
    that later moves leave alone.
    """
    if sort not in ("lexicographic", "none"):
        raise ValueError("sort must be 'lexicographic' or 'none'")
    require_columns(df, [slice_col, *(k for k in (keys.x_key, keys.y_key) if not {"x", "y"} <= set(df.columns))])
    x, y = ("x", "y") if {"x", "y"} <= set(df.columns) else (keys.x_key, keys.y_key)
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    named = df.withColumn("slice_id", F.coalesce(F.col(slice_col).cast("string"), F.lit("nan"))).withColumn("__row", row_id)
    # the slices are few; spots are numbered over ranges of the whole order, so a large slice is no single task
    ids = [r["slice_id"] for r in named.select("slice_id").distinct().collect()]
    ranked = order or sorted(ids)
    spark = df.sparkSession
    numbers = spark.createDataFrame([(s, i) for i, s in enumerate(ranked)], "slice_id string, slice_idx int")
    placed = numbered(named.join(F.broadcast(numbers), "slice_id"), ["slice_idx", "__row"], "__gid")
    counts = placed.groupBy("slice_idx").agg(F.count("*").alias("n_obs"))  # a row for each slice
    offsets = counts.withColumn("gid_offset", F.coalesce(F.sum("n_obs").over(Window.orderBy("slice_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rest = [c for c in df.columns if c not in {slice_col, "slice_id", x, y, "x", "y", "gid"}]
    return placed.join(F.broadcast(offsets), "slice_idx").select(
        F.col("__gid").alias("gid"),
        "slice_idx", "slice_id", (F.col("__gid") - F.col("gid_offset")).cast("int").alias("spot_idx"),
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
        F.col(x).cast("double").alias("x_raw"), F.col(y).cast("double").alias("y_raw"),
        *rest,
    )


class Later:
    """A table that is made when it is first asked for."""

    def __init__(self, make: Callable[[], DataFrame]):
        self.make, self.made = make, None

    def get(self) -> DataFrame:
        if self.made is None:
            self.made = self.make()
        return self.made


@dataclass(frozen=True)
class Cube:
    """A stack of slices: spots, and optionally features (gid, vec) and mapping edges. Nothing is changed in place.

    mapping may be given as Later, so that who asks for poses alone doesn't wait for it; it is read as a table.
    """

    spots: DataFrame
    embedding: DataFrame | None = None
    mapping: DataFrame | Later | None = None
    z_spacing: float = 1.0
    z_base: float = 0.0
    lambda_z: float = 0.01
    z_positions: tuple[float, ...] | None = None

    def __post_init__(self):
        if self.lambda_z <= 0:
            raise ValueError("lambda_z must be positive")
        require_columns(self.spots, ["gid", "slice_idx", "x", "y"])

    def __getattribute__(self, name):
        value = object.__getattribute__(self, name)
        return value.get() if isinstance(value, Later) else value

    def slices(self) -> DataFrame:
        """(slice_idx, slice_id, z, n_obs, gid_offset); slice_id is 'unknown' where a slice holds several ids."""
        return slice_table(self.spots, self.z_spacing, self.z_base, self.z_positions)

    def slice_infos(self) -> list[SliceInfo]:
        return [SliceInfo(r["slice_id"], r["z"], r["n_obs"]) for r in self.slices().orderBy("slice_idx").collect()]

    def spots_3d(self, scaled: bool = False) -> DataFrame:
        """Spots with z; scaled multiplies z by sqrt(lambda_z), so that squared distance is dx^2 + dy^2 + lambda_z dz^2."""
        z = F.col("z") * F.sqrt(F.lit(self.lambda_z)) if scaled else F.col("z")
        return self.spots.join(F.broadcast(self.slices().select("slice_idx", "z")), "slice_idx").withColumn("z", z)

    def with_clusters(self, labels: DataFrame) -> Cube:
        """labels (gid, cluster): one for each spot, or a ValueError."""
        from dataclasses import replace

        n, m, hit = self.spots.count(), labels.count(), self.spots.join(labels, "gid", "left_semi").count()
        if not n == m == hit:
            raise ValueError("labels must give one cluster for each spot")
        return replace(self, spots=self.spots.drop("cluster").join(labels.select("gid", F.col("cluster").cast("int").alias("cluster")), "gid"))


def slice_table(spots: DataFrame, z_spacing: float = 1.0, z_base: float = 0.0, z_positions: tuple[float, ...] | None = None) -> DataFrame:
    ids = F.col("slice_id") if "slice_id" in spots.columns else F.lit("unknown")
    counted = spots.groupBy("slice_idx").agg(F.count("*").alias("n_obs"), F.when(F.count_distinct(ids) == 1, F.min(ids)).otherwise("unknown").alias("slice_id"))
    before = Window.orderBy("slice_idx").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    z = F.lit(float(z_base)) + F.lit(float(z_spacing)) * F.col("slice_idx")
    if z_positions is not None:
        z = F.element_at(F.array(*(F.lit(float(v)) for v in z_positions)), F.col("slice_idx") + 1)
    return counted.select("slice_idx", "slice_id", z.alias("z"), "n_obs", F.coalesce(F.sum("n_obs").over(before), F.lit(0)).alias("gid_offset"))


def cube_from_list(parts: list[DataFrame], z_positions: list[float], **options) -> Cube:
    """A cube of slices given one by one; the list's order is the physical order."""
    if not parts:
        raise ValueError("a cube needs slices")
    if len(parts) != len(z_positions):
        raise ValueError("z_positions must give one z for each slice")
    stacked = None
    for i, p in enumerate(parts):
        require_columns(p, ["x", "y"])
        one = p.withColumn("slice_idx", F.lit(i))
        stacked = one if stacked is None else stacked.unionByName(one, allowMissingColumns=True)
    return Cube(stacked, z_positions=tuple(z_positions), **options)


def metadata(cube: Cube, scope: str, values: dict) -> DataFrame:
    """Rows (slice_idx, scope, key, value) of a record that each slice carries at export."""
    spark = cube.spots.sparkSession
    rows = spark.createDataFrame([(scope, k, str(v)) for k, v in sorted(values.items())], "scope string, key string, value string")
    return cube.spots.select("slice_idx").distinct().join(F.broadcast(rows))
