"""Plot-ready tables; the plotting packages are optional."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slabwise.functions.palette import colour, palette

#: Distinct values up to which a colour column counts as discrete.
MOST_DISCRETE = 48


def label_codes(points: DataFrame, color: str) -> DataFrame:
    """points with `code`: a number as a whole number, else its place among the sorted distinct values."""
    kind = dict(points.dtypes)[color]
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return points.withColumn("code", F.col(color).cast("int"))
    values = points.select(color).distinct().withColumn("code", F.row_number().over(Window.orderBy(color)) - 1)  # distinct labels
    return points.join(F.broadcast(values), color)


def is_discrete(points: DataFrame, color: str, wanted: bool = True) -> bool:
    return wanted and points.select(color).distinct().limit(MOST_DISCRETE + 1).count() <= MOST_DISCRETE


def traces(points: DataFrame, color: str) -> DataFrame:
    """A row for each label: (code, colour, n, x, y, z), the coordinates as arrays in the order of gid. For a plot's worth of points."""
    rows = label_codes(points, color).groupBy("code").agg(F.sort_array(F.collect_list(F.struct("gid", "x", "y", "z"))).alias("p"))
    part = lambda c: F.transform("p", lambda p: p[c])
    return rows.select("code", colour("code").alias("colour"), F.size("p").alias("n"), part("x").alias("x"), part("y").alias("y"), part("z").alias("z"))


def scatter_table(points: DataFrame, color: str | None = None) -> DataFrame:
    """Plain or continuous scatter: (gid, x, y, z, value)."""
    value: Column = F.col(color).cast("double") if color else F.lit(None).cast("double")
    return points.select("gid", "x", "y", "z", value.alias("value"))


def plotly_pointcloud(points: DataFrame, color: str | None = None, size: float = 2.0, discrete_colors: bool = True, **layout):
    """A Plotly figure of points (gid, x, y, z)."""
    _require_3d(points)
    try:
        import plotly.graph_objects as go
    except ImportError as e:
        raise ImportError("plotly is needed for this plot: pip install plotly") from e
    fig = go.Figure(layout=layout)
    if color and is_discrete(points, color, discrete_colors):
        for r in traces(points, color).orderBy("code").collect():
            fig.add_trace(go.Scatter3d(x=r["x"], y=r["y"], z=r["z"], mode="markers", name=str(r["code"]), marker={"size": size, "color": r["colour"]}))
        return fig
    pdf = scatter_table(points, color).toPandas()
    fig.add_trace(go.Scatter3d(x=pdf["x"], y=pdf["y"], z=pdf["z"], mode="markers", marker={"size": size} | ({"color": pdf["value"]} if color else {})))
    return fig


def pyvista_pointcloud(points: DataFrame, scalars: str | None = None, point_size: float = 3.0, **options):
    """A PyVista plotter of points (gid, x, y, z), coloured by `scalars` if given."""
    _require_3d(points)
    try:
        import pyvista as pv
    except ImportError as e:
        raise ImportError("pyvista is needed for this plot: pip install pyvista") from e
    pdf = scatter_table(points, scalars).toPandas()
    cloud = pv.PolyData(pdf[["x", "y", "z"]].to_numpy(float))
    plotter = pv.Plotter()
    if scalars:
        cloud["scalars"] = pdf["value"].to_numpy()
        options = {"scalars": "scalars"} | options
    plotter.add_mesh(cloud, point_size=point_size, render_points_as_spheres=True, **options)
    return plotter


def _require_3d(points: DataFrame) -> None:
    if not {"x", "y", "z"} <= set(points.columns):
        raise ValueError("points need x, y and z")


__all__ = ["palette", "label_codes", "is_discrete", "traces", "scatter_table", "plotly_pointcloud", "pyvista_pointcloud"]
