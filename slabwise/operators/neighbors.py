"""Neighbour joins: exact k nearest by grid cells, radius by grid cells, and nearest in feature space by blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slabwise.functions.blocks import rows_of
from slabwise.session import cut

from . import metric

#: Targets of a part up to which its sources are held against all of them, block by block; beyond, cells are made. The result is the same.
SMALL = 4096

#: Rows of a block: two of them meet in a task.
BLOCK = 2048

#: A cell is cut into four while it holds more targets than this many times what a cell holds of evenly spread ones; how often at most, and levels counted in one pass.
CROWDED, MOST_LEVELS, LEVEL_STEP = 8, 43, 6

#: Cells along a tile's side; sources and targets up to which one task searches a tile, fuller ones are joined by cells; pairs of a source and a target that it holds at once.
TILE, TILE_ROWS, TILE_PAIRS = 16, 400_000, 500_000


def _cell_sizes(points: DataFrame, k: int) -> DataFrame:
    """(part, h, bounding box): a cell side for each part, so that a circle of that radius holds k points but for few spots.

    Where points lie evenly the number in a circle varies by its square root: k + 3 sqrt(k) + 2 are expected.
    """
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)]
    box = points.groupBy("part").agg(F.count("*").alias("n"), *ends).withColumns({"w": F.expr("max_x - min_x"), "d": F.expr("max_y - min_y")})
    area = F.greatest(F.col("w"), F.lit(1e-9)) * F.greatest(F.col("d"), F.lit(1e-9))
    h = F.greatest(F.sqrt(area * ((k + 3 * math.sqrt(k) + 2) / math.pi) / F.col("n")), F.greatest("w", "d") / F.lit(1e6), F.lit(1e-9))
    return box.select("part", "n", h.alias("h"), "min_x", "max_x", "min_y", "max_y")


def _cell(c: str, level: Column) -> Column:
    """The cell of a coordinate at a level: sides are h / 2^level."""
    return F.floor(F.col(c) * F.pow(F.lit(2.0), level) / F.col("h")).cast("long")


def _levels(sources: DataFrame, targets: DataFrame, most: int) -> tuple[DataFrame, list[int]]:
    """sources with `level`, the first at which the source's own cell holds at most `most` targets, and the levels there are. Both have (part, x, y, h)."""
    keys, left, todo, done = ["part", "level", "cx", "cy"], targets.select("part", "x", "y", "h"), sources.withColumn("level", F.lit(0)), None
    at = {"cx": _cell("x", F.col("level")), "cy": _cell("y", F.col("level"))}
    for low in (0, *range(1, MOST_LEVELS, LEVEL_STEP)):
        high = low + (LEVEL_STEP if low else 1)  # mostly no cell is crowded: level 0 is looked at by itself
        each = F.explode(F.sequence(F.lit(low), F.lit(high - 1)))
        crowded = left.withColumn("level", each).withColumns(at).groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(*keys)
        if not crowded.limit(1).count():
            break
        crowded = cut(crowded)
        left = cut(left.withColumn("level", F.lit(high - 1)).withColumns(at).join(crowded, keys, "left_semi").select("part", "x", "y", "h"))
        # a crowded cell lies in crowded cells: the last crowded level decides
        over = todo.withColumn("level", each).withColumns(at).join(crowded, keys).groupBy("src", "part").agg((F.max("level") + 1).alias("next"))
        mine = cut(todo.join(over, ["src", "part"], "left").withColumn("level", F.coalesce("next", "level")).drop("next"))
        fine = mine.filter(F.col("level") < high)
        done = fine if done is None else done.unionByName(fine)
        todo = mine.filter(F.col("level") == high)
    if done is None:
        return todo, [0]
    every = cut(done.unionByName(todo))
    return every, _levels_of(every)


def _levels_of(todo: DataFrame) -> list[int]:
    return sorted(r["level"] for r in todo.select("level").distinct().collect())  # a few numbers


def _nearest(sources: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """The k targets nearest to each source within its part, exactly: (part, src, dst, d2, rank). Both have (part, id, x, y). Ties go to the lesser target."""
    sizes = cut(_cell_sizes(targets, k))  # a row for each slice
    small = [r["n"] <= SMALL for r in sizes.select("n").collect()]
    found = []
    if any(small) or not small:
        few = F.broadcast(sizes.filter(F.col("n") <= SMALL).select("part"))
        sides = (x.join(few, "part", "left_semi").select("part", F.col("id").alias("gid"), F.array("x", "y").alias("vec")) for x in (sources, targets))
        found.append(vector_knn(*sides, k, SMALL).select("part", "src", "dst", "d2", "rank"))
    if not all(small):
        found.append(_nearest_by_cells(sources, targets, sizes.filter(F.col("n") > SMALL), k))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _nearest_by_cells(sources: DataFrame, targets: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """_nearest by cells in levels, for the parts in sizes.

    Cells come in levels, each of half the side of the one before. A source starts at
    the level at which its own cell isn't crowded and looks at the targets of the 3 x 3
    cells around it. What lies outside is at least a cell's side away, so its k nearest
    are final if the k-th is no farther than that; the others look again a level up (from
    the fourth time on several at once), until their cells cover the part. Of targets at one place only the k + 1 least can be
    among the k nearest of any source, so only those are looked at.
    """
    sizes = F.broadcast(sizes)  # a row for each slice
    here = Window.partitionBy("part", "x", "y").orderBy("id")
    held = cut(targets.withColumn("n", F.row_number().over(here)).filter(F.col("n") <= k + 1).drop("n").join(sizes.select("part", "h"), "part"))
    far = F.greatest(F.abs(F.col("x") - F.col("min_x")), F.abs(F.col("x") - F.col("max_x")), F.abs(F.col("y") - F.col("min_y")), F.abs(F.col("y") - F.col("max_y")))
    even = (k + 3 * math.sqrt(k) + 2) / math.pi
    turn = 0
    todo, levels = _levels(sources.join(sizes, "part").select("part", F.col("id").alias("src"), "x", "y", "h", far.alias("far")), held, math.ceil(CROWDED * even))
    out = None
    while True:
        grid = held.withColumn("level", F.explode(F.array(*(F.lit(x) for x in levels))))
        grid = grid.select("part", "level", _cell("x", F.col("level")).alias("cx"), _cell("y", F.col("level")).alias("cy"), F.col("id").alias("dst"), F.col("x").alias("tx"), F.col("y").alias("ty"))
        side = (F.col("h") / F.pow(F.lit(2.0), F.col("level"))).alias("side")
        asked = todo.select("part", "level", "src", "x", "y", side, "far", _cell("x", F.col("level")).alias("cx"), _cell("y", F.col("level")).alias("cy"))
        ranked = cut(_looked_up(asked, grid, k))
        done = ranked.filter("sure").select("part", "src", "dst", "d2", "rank")
        out = done if out is None else out.unionByName(done)
        # cells that cover the part have shown all there is, also where that is nothing
        again = todo.filter(F.col("far") >= F.col("h") / F.pow(F.lit(2.0), F.col("level"))).join(done.filter("rank = 1").select("src"), "src", "left_anti")
        todo, turn = cut(again.withColumn("level", F.col("level") - max(1, 2 ** (turn - 2)))), turn + 1
        levels = _levels_of(todo)
        if not levels:
            return out


def _looked_up(asked: DataFrame, grid: DataFrame, k: int) -> DataFrame:
    """The k nearest among the targets of the 3 x 3 cells around each source, and whether they are final: (part, src, dst, d2, rank, sure).

    asked has (part, level, cx, cy, src, x, y, side, far), grid (part, level, cx, cy, dst, tx, ty). Cells stand
    together in tiles: a source goes to its tile, a target to each tile that has a cell beside its own, so
    one exchange of both serves the search, and pairs are never rows. Tiles of very many rows go by cells.
    """
    keys = ["part", "level", "u", "v"]
    tile = lambda c: F.floor(c / F.lit(TILE)).cast("long")
    beside = lambda c: F.explode(F.array_distinct(F.array(tile(F.col(c) - 1), tile(F.col(c) + 1))))
    targets = grid.withColumn("u", beside("cx")).withColumn("v", beside("cy"))
    sources = asked.withColumns({"u": tile(F.col("cx")), "v": tile(F.col("cy"))})
    full = sources.select(*keys).unionByName(targets.select(*keys)).groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > TILE_ROWS).select(*keys)
    rest = None
    if full.limit(1).count():
        full = cut(full)  # few: each has many rows
        rest = _looked_up_by_cells(sources.join(F.broadcast(full), keys, "left_semi"), grid, k)
        sources, targets = (x.join(F.broadcast(full), keys, "left_anti") for x in (sources, targets))
    both = sources.select(*keys, "cx", "cy", F.col("src").alias("id"), "x", "y", "side", "far").unionByName(
        targets.select(*keys, "cx", "cy", F.col("dst").alias("id"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.lit(-1.0).alias("side"), F.lit(0.0).alias("far"))
    )
    kind = asked.schema["part"].dataType.simpleString()
    found = both.groupBy(*keys).applyInArrow(lambda table: _searched_tile(table, k), f"part {kind}, src long, dst long, d2 double, rank int, sure boolean")
    return found if rest is None else found.unionByName(rest)


def _searched_tile(table: pa.Table, k: int) -> pa.Table:
    """_looked_up of one tile: its targets in the order of their cells, so that each row of three cells around a source is one stretch of them."""
    cx, cy, ids, x, y, side, far = (table.column(c).to_numpy() for c in ("cx", "cy", "id", "x", "y", "side", "far"))
    s, t = np.flatnonzero(side >= 0), np.flatnonzero(side < 0)
    cx, cy = cx - table.column("u")[0].as_py() * TILE + 1, cy - table.column("v")[0].as_py() * TILE + 1
    place = cx * (TILE + 2) + cy
    t = t[np.argsort(place[t], kind="stable")]
    low = np.stack([np.searchsorted(place[t], place[s] + i * (TILE + 2) - 1) for i in (-1, 0, 1)], axis=1)
    many = np.stack([np.searchsorted(place[t], place[s] + i * (TILE + 2) + 1, side="right") for i in (-1, 0, 1)], axis=1) - low
    upto = np.cumsum(many.sum(axis=1))
    out, start = [], 0
    while start < len(s):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + TILE_PAIRS, side="right")))
        n = many[start:end].ravel()
        first = np.cumsum(n) - n
        i = np.repeat(np.arange(start, end), many[start:end].sum(axis=1))
        j = t[np.arange(len(i)) + np.repeat(low[start:end].ravel() - first, n)]
        start = end
        other = ids[s[i]] != ids[j]
        i, j = i[other], j[other]
        dx, dy = x[s[i]] - x[j], y[s[i]] - y[j]
        d = dx * dx + dy * dy
        kept = _within_kth(i, d, k)
        i, j, d = i[kept], j[kept], d[kept]
        order = np.lexsort((ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        fresh = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, dtype=int)
        rank = np.arange(len(i)) - np.repeat(fresh, np.diff(np.append(fresh, len(i))))
        near = rank < k
        i, j, d, rank = i[near], j[near], d[near], rank[near] + 1
        last = np.zeros(len(s))
        last[i[rank == k]] = d[rank == k]
        whole = np.zeros(len(s), dtype=bool)
        whole[i[rank == k]] = True
        own = s[i]
        out.append((ids[own], ids[j], d, rank, whole[i] & (last[i] <= side[own] * side[own]) | (far[own] < side[own])))
    src, dst, d2, rank, sure = (np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(5))
    part = pa.array([table.column("part")[0].as_py()] * len(src), table.schema.field("part").type)
    return pa.table({"part": part, "src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "d2": pa.array(d2, pa.float64()), "rank": pa.array(rank, pa.int32()), "sure": pa.array(sure, pa.bool_())})


def _within_kth(i: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the pairs that are no farther than the k-th of their source, ties included; i is sorted. Sources of very uneven numbers of pairs keep all: the sort decides either way."""
    n = np.bincount(i - i[0]) if len(i) else np.zeros(1, dtype=int)
    if n.max() <= k or len(n) * n.max() > 4 * len(i):
        return np.arange(len(i))
    table = np.full((len(n), n.max()), np.inf)
    table[i - i[0], np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)] = d
    kth = np.partition(table, k - 1, axis=1)[:, k - 1]
    return np.flatnonzero(~(d > kth[i - i[0]]))


def _looked_up_by_cells(asked: DataFrame, grid: DataFrame, k: int) -> DataFrame:
    """_looked_up by a join of cells, for tiles that no task should hold."""
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    asked = asked.withColumn("i", F.explode(around)).withColumn("j", F.explode(around)).withColumns({"cx": F.col("cx") + F.col("i"), "cy": F.col("cy") + F.col("j")})
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    pairs = asked.join(grid, ["part", "level", "cx", "cy"]).filter(F.col("src") != F.col("dst")).select("part", "src", "dst", "side", "far", (dx * dx + dy * dy).alias("d2"))
    own = Window.partitionBy("part", "src")
    ranked = pairs.withColumn("rank", F.row_number().over(own.orderBy("d2", "dst"))).filter(F.col("rank") <= k)
    certain = (F.count("*").over(own) >= k) & (F.max("d2").over(own) <= F.col("side") * F.col("side"))
    return ranked.select("part", "src", "dst", "d2", "rank", (certain | (F.col("far") < F.col("side"))).alias("sure"))


def knn_within(spots: DataFrame, k: int) -> DataFrame:
    """The k nearest other spots of each spot's slice, by XY: (slice_idx, src, dst, d2, rank)."""
    points = cut(spots.select(F.col("slice_idx").alias("part"), F.col("gid").alias("id"), "x", "y"))
    return _nearest(points, points, k).select(F.col("part").alias("slice_idx"), "src", "dst", "d2", "rank")


def _between(spots: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """Spots of slice i and of slice i + step, under the part i."""
    low = spots.select(F.col("slice_idx").alias("part"), F.col("gid").alias("id"), "x", "y")
    return low, low.withColumn("part", F.col("part") - step)


def knn_across(spots: DataFrame, k: int, lambda_z: float = 0.01, z_spacing: float = 1.0) -> DataFrame:
    """The k nearest spots of the next slice, and of the one before: (src_slice, src, dst, d2, rank, forward).

    Within a pair of slices the distance along z is constant: it ranks nothing, but
    d2 includes lambda_z * dz^2. A spot on the very edge of the other slice's box still
    finds its nearest, as blocks grow until they cover it.
    """
    extra = lambda_z * z_spacing * z_spacing
    parts = []
    for step in (1, -1):
        mine, theirs = _between(spots, step)
        boxed = _nearest(cut(mine.join(theirs.select("part").distinct(), "part", "left_semi")), cut(theirs), k)
        parts.append(boxed.withColumn("forward", F.lit(step == 1)))
    both = parts[0].unionByName(parts[1]).withColumn("d2", F.col("d2") + F.lit(extra))
    return both.select(F.col("part").alias("src_slice"), "src", "dst", "d2", "rank", "forward")


def _radius(sources: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """Pairs of a part within the radius: cells of the radius' size, 3 x 3 of them for each source."""
    cell = lambda c: F.floor(F.col(c) / F.lit(radius)).cast("long")
    grid = targets.select("part", cell("x").alias("cx"), cell("y").alias("cy"), F.col("id").alias("dst"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    asked = sources.withColumn("i", F.explode(near)).withColumn("j", F.explode(near))
    asked = asked.select("part", F.col("id").alias("src"), "x", "y", (cell("x") + F.col("i")).alias("cx"), (cell("y") + F.col("j")).alias("cy"))
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    return asked.join(grid, ["part", "cx", "cy"]).select("part", "src", "dst", (dx * dx + dy * dy).alias("d2")).filter((F.col("src") != F.col("dst")) & (F.col("d2") <= radius * radius))


def radius_within(spots: DataFrame, radius: float) -> DataFrame:
    """All pairs of a slice within the radius, in both directions: (slice_idx, src, dst, d2)."""
    points = spots.select(F.col("slice_idx").alias("part"), F.col("gid").alias("id"), "x", "y")
    return _radius(points, points, radius).withColumnRenamed("part", "slice_idx")


def radius_pairs(spots: DataFrame, radius: float) -> DataFrame:
    """radius_within with each pair once, src < dst: (slice_idx, src, dst, d2). A cell meets itself and four of the eight around it."""
    cell = lambda c: F.floor(F.col(c) / F.lit(radius)).cast("long")
    points = spots.select(F.col("slice_idx").alias("part"), F.col("gid").alias("id"), "x", "y")
    grid = points.select("part", cell("x").alias("cx"), cell("y").alias("cy"), F.col("id").alias("b"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    half = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)))))
    asked = points.withColumn("to", half).select("part", F.col("id").alias("a"), "x", "y", "to", (cell("x") + F.col("to.i")).alias("cx"), (cell("y") + F.col("to.j")).alias("cy"))
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    own = (F.col("to.i") == 0) & (F.col("to.j") == 0)
    pairs = asked.join(grid, ["part", "cx", "cy"]).filter((F.col("a") < F.col("b")) | ~own & (F.col("a") > F.col("b")))
    return pairs.select(F.col("part").alias("slice_idx"), F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), (dx * dx + dy * dy).alias("d2")).filter(F.col("d2") <= radius * radius)


def radius_across(spots: DataFrame, radius: float, lambda_z: float = 0.01, z_spacing: float = 1.0) -> DataFrame:
    """Pairs of a slice and the next within the radius in scaled 3D, forward only: (src_slice, src, dst, d2)."""
    extra = lambda_z * z_spacing * z_spacing
    flat = radius * radius - extra
    low, high = _between(spots, 1)
    if flat < 0:
        flat, low = 0.0, low.filter("false")
    return _radius(low, high, max(math.sqrt(flat), 1e-12)).select(F.col("part").alias("src_slice"), "src", "dst", (F.col("d2") + F.lit(extra)).alias("d2"))


def feature_knn(features: DataFrame, k: int, step: int = -1, part: str = "slice_idx") -> DataFrame:
    """For each row of a slice the k rows of the slice `step` away that are nearest in features: (src, dst, d2, rank).

    features has (gid, part, vec); step 0 searches the row's own slice, without itself.
    """
    rows = features.select(F.col(part).cast("int").alias("part"), "gid", "vec")
    return vector_knn(rows, rows.withColumn("part", F.col("part") - step), k).drop("part")


def vector_knn(sources: DataFrame, targets: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The k targets nearest to each source of their part: (part, src, dst, d2, rank). Both have (part, gid, vec).

    Parts of no more targets than a block are searched block against block by matrix
    products; where a part has more, targets are grouped around pivots and a source meets
    only groups that can hold one of its k. Distances of all that may be among the k,
    ties included, are summed up exactly. Ties go to the lesser id, and no row is its own
    neighbour.
    """
    kind = sources.schema["part"].dataType.simpleString()
    sides = [cut(x.select("part", "gid", F.col("vec").cast("array<double>").alias("vec"))) for x in (sources, targets)]
    # a row for each part
    blocks = [x.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias(n)) for x, n in zip(sides, ("ns", "nt"))]
    if (blocks[1].agg(F.max("nt")).first()[0] or 0) > 1:
        return metric.nearest(*sides, k, block)[0]
    whole = [x.join(F.broadcast(blocks[0]), "part").join(F.broadcast(blocks[1]), "part") for x in sides]
    own = lambda n: F.pmod(F.xxhash64("gid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    src = whole[0].withColumn("sb", own("ns")).withColumn("tb", every("nt")).select("part", "sb", "tb", F.lit(0).alias("side"), "gid", "vec")
    dst = whole[1].withColumn("tb", own("nt")).withColumn("sb", every("ns")).select("part", "sb", "tb", F.lit(1).alias("side"), "gid", "vec")

    found = src.unionByName(dst).groupBy("part", "sb", "tb").applyInArrow(lambda table: _scored(table, k), f"part {kind}, src long, dst long, d2 double")
    best = Window.partitionBy("part", "src").orderBy("d2", "dst")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _scored(table: pa.Table, k: int) -> pa.Table:
    """vector_knn of a block of sources (side 0) and one of targets (side 1), some sources at a time."""
    side, gid = table.column("side").to_numpy(), table.column("gid").to_numpy()
    vec = rows_of(table.column("vec").combine_chunks())
    s, t = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    kind, part = table.schema.field("part").type, table.column("part")[0].as_py()
    ids, rows, far = gid[t], vec[t], np.full(metric.TOGETHER, np.inf)
    some = [s[low : low + metric.TOGETHER] for low in range(0, len(s) if len(t) else 0, metric.TOGETHER)]
    found = [metric._nearest(kind, part, gid[i], vec[i], far[: len(i)], ids, rows, k) for i in some]
    return pa.Table.from_batches(found, pa.schema([("part", kind), ("src", pa.int64()), ("dst", pa.int64()), ("d2", pa.float64())]))


def mutual_neighbours(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Pairs (u, v) where v is among u's neighbours and u among v's."""
    return forward.select(F.col("src").alias("u"), F.col("dst").alias("v")).join(backward.select(F.col("dst").alias("u"), F.col("src").alias("v")), ["u", "v"])


def subsample(spots: DataFrame, most: int | None, seed: int = 0, part: str = "slice_idx") -> DataFrame:
    """At most `most` rows of each slice, those of least md5 of seed and id; all of a slice that has no more, or where most is None."""
    if most is None:
        return spots
    rank = Window.partitionBy(part).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("gid").cast("string"))), "gid")
    return spots.withColumn("__n", F.row_number().over(rank)).filter(F.col("__n") <= most).drop("__n")
