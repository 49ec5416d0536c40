"""Exact nearest vectors by metric pruning.

Targets stand around pivots. Of every part and pivot a small table keeps how many targets
there are and how near and far they lie; cells that follow each other form groups of
bounded size, which stay where they are while sources are sent to them. A source first
meets the cells around its own place, until these hold k targets. By the triangle
inequality a target in a cell whose distances to its pivot lie in [near, far] is at least
max(d - far, near - d) away from a source at distance d of the pivot: only groups with a
cell where that is no more than the source's k-th distance so far are then met.

Groups that follow each other stand together in a bundle, and a source is sent to a bundle once,
with a bit for each of its groups that it meets: where hardly any group is spared, as with
features of many even dimensions, a source would else be copied as often as there are groups.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slabwise.functions.blocks import rows_of
from slabwise.session import cut, shuffle_width

#: Rows from which pivots are made, and pivots at most: bounds of what is broadcast, not of what is searched.
SAMPLE, MOST_PIVOTS = 4096, 512

#: What rounding may do to a distance, relative to the numbers it is made of.
SLACK = 1e-9

#: A source is sent to so many groups at most, while these hold no more than the root of GROUP times the targets: groups grow with the targets, so that copies don't grow as fast.
MOST_GROUPS, GROUP = 64, 150

#: Numbers in the vectors of a bundle's groups, and groups of a bundle, at most: what a task holds of targets. Bundles are left small while there would be fewer than SPREAD for each core.
HELD, MOST_BITS, SPREAD = 1 << 22, 62, 2

#: Sources that are held against a group, or against the pivots, at once.
TOGETHER = 256


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances, each from its differences, so that none loses digits; in slices of bounded size."""
    out = np.empty((len(x), len(c)))
    for i, p in enumerate(c):
        out[:, i] = np.sqrt(((x - p) ** 2).sum(axis=1))
    return out


def pivots_of(targets: DataFrame, n: int, wanted: int) -> np.ndarray:
    """About `wanted` means of a bounded sample of the targets, each next to the one most like it among the rest."""
    space = 1_000_000_000
    share = min(space, math.ceil(space * SAMPLE / max(1, n)))
    sample = targets.filter(F.pmod(F.xxhash64("gid", "vec"), F.lit(space)) < share).select("vec").distinct().toArrow()
    rows = rows_of(sample.column("vec").combine_chunks()) if sample.num_rows else rows_of(targets.select("vec").limit(1).toArrow().column("vec").combine_chunks())
    rows = rows[np.lexsort(rows.T)]
    rng = np.random.default_rng(3)
    centres = rows[np.sort(rng.permutation(len(rows))[:wanted])].copy()
    for _ in range(5):
        own = np.concatenate([((part**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * part @ centres.T).argmin(axis=1) for part in np.array_split(rows, math.ceil(len(rows) / 512))])
        total, count = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(total, own, rows)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    left, order = list(range(len(centres))), []
    while left:
        last = centres[order[-1] if order else left[0]]
        order.append(left.pop(int(((centres[left] - last) ** 2).sum(axis=1).argmin())))
    return centres[order]


def _grouped(counts: list[int], most: int) -> tuple[list[int], list[int]]:
    """First group and number of groups of each cell in turn: following cells share a group of about `most` rows, a larger one has several."""
    first, parts, group, room = [], [], 0, most
    for n in counts:
        if n > room and room < most:
            group, room = group + 1, most
        first.append(group)
        parts.append(max(1, math.ceil(n / most)))
        group, room = (group + parts[-1], most) if parts[-1] > 1 else (group, room - n)
    return first, parts


def group_size(n: int, block: int) -> int:
    """Rows of a group of n targets: a block, or more where blocks would be too many to send sources to."""
    return max(block, min(math.ceil(n / MOST_GROUPS), math.ceil(math.sqrt(GROUP * n))))


def bundle_size(rows: int, dim: int, groups: int, cores: int) -> int:
    """Groups of a bundle, where the largest has so many rows and there are so many groups in all."""
    return max(1, min(MOST_BITS, HELD // max(1, rows * dim), groups // (SPREAD * cores)))


class Targets:
    """Targets (part, gid, vec) in their groups, and the table of cells: part -> (cell, n, near, far, first group, groups). fan: groups of a bundle (b)."""

    def __init__(self, targets: DataFrame, block: int):
        self.spark = targets.sparkSession
        n = targets.count()
        self.pivots = pivots_of(targets, n, max(16, min(MOST_PIVOTS, 4 * math.ceil(n / block))))
        self.shared = self.spark.sparkContext.broadcast(self.pivots)
        kind, shared = targets.schema["part"].dataType.simpleString(), self.shared

        def place(batches):
            for batch in batches:
                if batch.num_rows:
                    d = np.concatenate([_distances(rows_of(batch.column("vec").slice(i, TOGETHER)), shared.value) for i in range(0, batch.num_rows, TOGETHER)])
                    cell = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], names=["part", "gid", "vec", "cell", "far"])

        placed = cut(targets.select("part", "gid", "vec").mapInArrow(place, f"part {kind}, gid long, vec array<double>, cell int, far double"))
        rows = placed.groupBy("part", "cell").agg(F.count("*").alias("n"), F.min("far").alias("near"), F.max("far").alias("far")).orderBy("part", "cell").collect()  # a row for each part and pivot at most
        by_part: dict = {}
        for r in rows:
            by_part.setdefault(r["part"], []).append(r)
        self.cells, table = {}, []
        for part, own in by_part.items():
            first, parts = _grouped([r["n"] for r in own], group_size(sum(r["n"] for r in own), block))
            self.cells[part] = tuple(np.array(x) for x in ([r["cell"] for r in own], [r["n"] for r in own], [r["near"] for r in own], [r["far"] for r in own], first, parts))
            table += [(part, r["cell"], f, p) for r, f, p in zip(own, first, parts)]
        self.groups = {part: int((c[4] + c[5]).max()) for part, c in self.cells.items()}
        most = max((group_size(sum(r["n"] for r in own), block) for own in by_part.values()), default=block)
        self.fan = bundle_size(most, self.pivots.shape[1], sum(self.groups.values()), self.spark.sparkContext.defaultParallelism)
        where = F.broadcast(self.spark.createDataFrame(table, f"part {kind}, cell int, first int, parts int"))
        g = (F.col("first") + F.pmod(F.xxhash64("gid"), F.col("parts"))).cast("int")
        fan = self.fan
        bundled = placed.join(where, ["part", "cell"]).withColumn("g", g).withColumns({"b": F.floor(F.col("g") / fan).cast("int"), "bits": F.expr(f"shiftleft(1L, g % {fan})")})
        self.rows = cut(bundled.select("part", "b", "bits", "gid", "vec"))

    def routed(self, sources: DataFrame, k: int, again: bool) -> DataFrame:
        """Sources (part, gid, vec, kth) once for each bundle (b) with groups they meet (bits): the cells around them that hold k, or again=True, all others that can hold one within kth."""
        kind, shared, fan = sources.schema["part"].dataType.simpleString(), self.shared, self.fan
        cells = self.spark.sparkContext.broadcast(self.cells)

        def route(batches):
            for batch in batches:
                parts = np.array(batch.column("part").to_pylist(), dtype=object)
                for part in dict.fromkeys(parts.tolist()):
                    if part not in cells.value:
                        continue
                    cell, n, near, far, first, more = cells.value[part]
                    rows = np.flatnonzero(parts == part)
                    every = np.arange(math.ceil(int((first + more).max()) / fan) * fan)
                    groups = ((every >= first[:, None]) & (every < (first + more)[:, None])).astype(np.float32)  # of each cell
                    for i in range(0, len(rows), TOGETHER):
                        some = batch.take(pa.array(rows[i : i + TOGETHER]))
                        d = _distances(rows_of(some.column("vec")), shared.value[cell])
                        order = np.argsort(d, axis=1, kind="stable")
                        held = np.cumsum(n[order], axis=1) - n[order] <= k  # one may be the source itself
                        home = np.zeros_like(held)
                        np.put_along_axis(home, order, held, axis=1)
                        met = home.astype(np.float32) @ groups > 0
                        if again:
                            kth = some.column("kth").to_numpy()[:, None]
                            lower = np.maximum(d - far, near - d)
                            reach = ~(lower > kth + SLACK * (kth + d + far))
                            met = (reach.astype(np.float32) @ groups > 0) & ~met
                        bits = met.reshape(len(met), -1, fan) @ (np.int64(1) << np.arange(fan))
                        row, b = np.nonzero(bits)
                        sent = some.take(pa.array(row))
                        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(bits[row, b], pa.int64()), *sent.columns], names=["b", "bits", *sent.schema.names])

        return sources.select("part", "gid", "vec", "kth").mapInArrow(route, f"b int, bits long, part {kind}, gid long, vec array<double>, kth double")

    def met(self, routed: DataFrame, k: int) -> DataFrame:
        """(part, src, dst, d2): of each source and bundle it is sent to, the k nearest other targets in the groups it meets that are within kth."""
        kind = routed.schema["part"].dataType.simpleString()
        t = self.rows.select("part", "b", F.lit(0).alias("side"), "bits", "gid", "vec", F.lit(0.0).alias("kth"))
        s = routed.select("part", "b", F.lit(1).alias("side"), "bits", "gid", "vec", "kth")
        width = max(shuffle_width(self.spark), sum(math.ceil(n / self.fan) for n in self.groups.values()))
        pairs = t.unionByName(s).repartition(min(width, 100_000), "part", "b").sortWithinPartitions("part", "b", "side", "bits", "gid")
        return pairs.mapInArrow(lambda it: _searched(it, k), f"part {kind}, src long, dst long, d2 double")


def _searched(batches, k):
    """Targets of a bundle come first, group by group, then its sources in any number, of which a batch is held at a time."""
    key, ids, rows, bits = None, [], [], []
    for batch in batches:
        part, b, side = (batch.column(c).to_pylist() for c in ("part", "b", "side"))
        start = 0
        for end in range(1, len(part) + 1):
            if end < len(part) and (part[end], b[end], side[end]) == (part[start], b[start], side[start]):
                continue
            if (part[start], b[start]) != key:
                key, ids, rows, bits = (part[start], b[start]), [], [], []
            own = batch.slice(start, end - start)
            gid, vec, met = own.column("gid").to_numpy(), rows_of(own.column("vec")), own.column("bits").to_numpy()
            if side[start] == 0:
                ids.append(gid)
                rows.append(vec)
                bits.append(met)
            elif ids:
                if len(ids) > 1:
                    ids, rows, bits = [np.concatenate(ids)], [np.concatenate(rows)], [np.concatenate(bits)]
                kth = own.column("kth").to_numpy()
                for i in range(0, len(gid), TOGETHER):
                    some = slice(i, i + TOGETHER)
                    yield _nearest(own.schema.field("part").type, key[0], gid[some], vec[some], kth[some], ids[0], rows[0], k, met[some], bits[0])
            start = end


def _nearest(kind, part, gid, vec, kth, ids, rows, k, met=None, bits=None) -> pa.RecordBatch:
    """The k nearest rows of each of some vectors that are within kth; with bits, which are sorted, of the rows with one of the bits of the vector's met, group by group."""
    starts = [0] if bits is None else [0, *(np.flatnonzero(bits[1:] != bits[:-1]) + 1).tolist()]
    kth = np.array(kth, dtype=float)
    i, j, d = np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)
    for start, end in zip(starts, [*starts[1:], len(ids)]):
        own = np.arange(len(gid)) if bits is None else np.flatnonzero(met & bits[start])
        if len(own) and end > start:
            more = _within(gid[own], vec[own], kth[own], ids[start:end], rows[start:end], k)
            i, j, d = (np.concatenate(x) for x in ((i, own[more[0]]), (j, start + more[1]), (d, more[2])))
            order = np.lexsort((ids[j], d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, dtype=int)
            place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
            last = place == k - 1  # no row of a further group counts beyond it
            kth[i[last]] = np.minimum(kth[i[last]], np.sqrt(d[last]))
            i, j, d = i[place < k], j[place < k], d[place < k]
    return pa.RecordBatch.from_arrays([pa.array([part] * len(i), kind), pa.array(gid[i], pa.int64()), pa.array(ids[j], pa.int64()), pa.array(d, pa.float64())], names=["part", "src", "dst", "d2"])


def _within(gid, vec, kth, ids, rows, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of a vector and another row with their exact d2, among them each vector's k nearest within kth: by rough distances first, and then by sums of all that may be among them, few at a time."""
    norm, own = (rows**2).sum(axis=1), (vec**2).sum(axis=1)
    # the distance's square without the vector's own part, in one product
    rough = np.column_stack([-2 * vec, np.ones(len(vec))]) @ np.column_stack([rows, norm]).T
    most = min(len(ids), k + 1)  # one of them may be the vector itself
    slack = 1e-15 * (vec.shape[1] + 8) * (own + norm.max())
    bound = kth**2 * (1 + SLACK) - own
    open_ = np.flatnonzero(~np.isfinite(bound))  # a known k-th distance bounds enough
    if len(open_):
        bound[open_] = np.minimum(np.partition(rough[open_], most - 1, axis=1)[:, most - 1], bound[open_])
    i, j = np.divmod(np.flatnonzero(~(rough > (bound + 4 * slack)[:, None])), len(ids))
    other = gid[i] != ids[j]
    i, j = i[other], j[other]
    d = np.concatenate([np.zeros(0), *(((rows[j[s : s + 8192]] - vec[i[s : s + 8192]]) ** 2).sum(axis=1) for s in range(0, len(i), 8192))])
    return i, j, d


def nearest(sources: DataFrame, targets: DataFrame, k: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame, Targets]:
    """The k targets nearest to each source of their part (part, src, dst, d2, rank), ties to the lesser id, never itself.

    Also returns what was sent to bundles in the first and in the second round, and the targets.
    """
    held = Targets(targets, block)
    best = Window.partitionBy("part", "src").orderBy("d2", "dst")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    home = held.routed(sources.withColumn("kth", F.lit(float("inf"))), k, again=False)
    first = cut(ranked(held.met(home, k)))
    kth = first.groupBy("part", F.col("src").alias("gid")).agg(F.when(F.count("*") == k, F.sqrt(F.max("d2"))).alias("kth"))
    bounded = sources.join(kth, ["part", "gid"], "left").select("part", "gid", "vec", F.coalesce("kth", F.lit(float("inf"))).alias("kth"))
    others = held.routed(bounded, k, again=True)
    found = first.drop("rank").unionByName(held.met(others, k))
    return ranked(found), home, others, held
