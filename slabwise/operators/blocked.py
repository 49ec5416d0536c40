"""Sparse matrices in row blocks, for products that are repeated.

The rows of a block stand together by place, so most of their columns are rows of the
same block. The matrix is dealt once: a block keeps its entries by column, and every node
knows the blocks that have a column of it. In a product a node's vector is sent to those
blocks alone, in one shuffle with the entries (12 bytes each); a task adds up a block's
rows as vectors come in, so what is shuffled grows with nodes and borders, not with
entries times the vectors' length, and what is held is one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabwise.functions.blocks import rows_of
from slabwise.session import cut, shuffle_width

from .ranking import numbered

#: Rows of a block, about, and entries whose products are made at once.
BLOCK, TOGETHER = 4096, 16_384

_BITS = 16


def places_of_ids(ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """(gid, block): nodes in the order of their ids."""
    return numbered(ids.select("gid").distinct(), ["gid"], "__n", 0).select("gid", F.floor(F.col("__n") / block).cast("int").alias("block"))


def places_of_spots(spots: DataFrame, block: int = BLOCK) -> DataFrame:
    """(gid, block): spots by slice and along a Z-order curve of its cells, so a block is a patch of a slice."""
    ends = spots.groupBy("slice_idx").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)))

    def spread(c: str) -> Column:
        side = F.greatest(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(1e-300))
        bits = F.least(F.lit(2**_BITS - 1), F.floor((F.col(c) - F.col(f"min_{c}")) / side * 2**_BITS)).cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return bits

    curve = spread("x").bitwiseOR(F.shiftleft(spread("y"), 1))
    placed = spots.select("gid", "slice_idx", "x", "y").join(F.broadcast(ends), "slice_idx").select("gid", "slice_idx", curve.alias("__z"))  # a row for each slice
    return numbered(placed, ["slice_idx", "__z", "gid"], "__n", 0).select("gid", F.floor(F.col("__n") / block).cast("int").alias("block"))


def _runs(batches, *keys: str):
    """(keys, rows) of consecutive rows with equal keys within each batch."""
    for batch in batches:
        found = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        start = 0
        for end in range(1, len(found) + 1):
            if end == len(found) or found[end] != found[start]:
                yield found[start], batch.slice(start, end - start)
                start = end


_BUILT = "block int, kind int, at int, gid long, ptr binary, row binary, w binary, own binary"


def _build(batches):
    """Of each block: its columns (kind 2) and rows (kind 1) in the order of their ids, and its entries by column (kind 0)."""

    def made(block, nodes, src, dst, w):
        own = np.unique(np.concatenate([*nodes, *src]))
        src, dst, w = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((src, np.int64), (dst, np.int64), (w, np.float64)))
        columns = np.union1d(own, dst)
        at = np.searchsorted(columns, dst)
        order = np.lexsort((src, at))
        ptr = np.searchsorted(at[order], np.arange(len(columns) + 1))
        self_row = np.full(len(columns), -1, dtype=np.int32)
        self_row[np.searchsorted(columns, own)] = np.arange(len(own))
        held = [ptr.astype(np.int64), np.searchsorted(own, src[order]).astype(np.int32), w[order], self_row]
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.nulls(1, pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in held)], names=[f.split()[0] for f in _BUILT.split(", ")])
        for kind, ids in ((1, own), (2, columns)):
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block), pa.int32()), pa.array(np.full(n, kind), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(ids, pa.int64()), *(pa.nulls(n, pa.binary()) for _ in range(4))], names=[f.split()[0] for f in _BUILT.split(", ")])

    current, nodes, src, dst, w = None, [], [], [], []
    for (block, kind), rows in _runs(batches, "block", "kind"):
        if block != current:
            if current is not None:
                yield from made(current, nodes, src, dst, w)
            current, nodes, src, dst, w = block, [], [], [], []
        if kind:
            src.append(rows.column("src").to_numpy())
            dst.append(rows.column("dst").to_numpy())
            w.append(rows.column("w").to_numpy())
        else:
            nodes.append(rows.column("src").to_numpy())
    if current is not None:
        yield from made(current, nodes, src, dst, w)


class BlockedMatrix:
    """A of entries (src, dst, w), which are added up where they repeat; places (gid, block) has all its rows and columns."""

    def __init__(self, edges: DataFrame, places: DataFrame):
        spark = self.spark = edges.sparkSession
        places = cut(places)
        nodes = places.select("block", F.lit(0).alias("kind"), F.col("gid").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(0.0).alias("w"))
        entries = edges.join(places.withColumnRenamed("gid", "src"), "src").select("block", F.lit(1).alias("kind"), "src", "dst", F.col("w").cast("double").alias("w"))
        dealt = nodes.unionByName(entries).repartition(self._width(), "block").sortWithinPartitions("block", "kind")
        built = cut(dealt.mapInArrow(_build, _BUILT))
        self.entries = built.filter("kind = 0").select("block", "ptr", "row", "w", "own")
        self.sent = built.filter("kind = 2").select("gid", "block", "at")
        to = self.sent.groupBy("gid").agg(F.collect_list(F.struct("block", "at")).alias("to"))  # one for each block that has a column of it
        self.nodes = cut(built.filter("kind = 1").select("block", "at", "gid").join(to, "gid"))
        self.plain = self.nodes.select("block", "at", "gid", F.lit(None).cast("array<double>").alias("vec"), "to")

    def _width(self) -> int:
        return shuffle_width(self.spark)

    def vectors(self, rows: DataFrame) -> DataFrame:
        """rows (gid, vec) as what a product takes: (gid, vec, to)."""
        return rows.select("gid", F.col("vec").cast("array<double>").alias("vec")).join(self.nodes.select("gid", "to"), "gid")

    def fixed(self, rows: DataFrame) -> DataFrame:
        """Nodes with the vector of `rows` that each product of an iteration is mixed with, null without one."""
        held = self.nodes.join(rows.select("gid", F.col("vec").cast("array<double>").alias("vec")), "gid", "left")
        return cut(held.select("block", "at", "gid", "vec", "to"))

    def times(self, vectors: DataFrame, fixed: DataFrame, mix: tuple[float, float, float] | None = None, mean: bool = False) -> DataFrame:
        """A·Z as (gid, vec, to, change, size), of rows that have an entry whose column has a vector.

        With mix (a, b, c), all rows that have a fixed vector x: a x + b (A Z), or c x without
        such an entry. mean divides a row's sum by the number of its entries. change and size are the
        squared lengths of the row's step from its vector before, and of that vector.
        """
        null = lambda t: F.lit(None).cast(t)
        to = "array<struct<block: int, at: int>>"
        sides = [
            self.entries.select("block", F.lit(0).alias("side"), F.lit(0).alias("at"), null("long").alias("gid"), null("array<double>").alias("vec"), null(to).alias("to"), "ptr", "row", "w", "own"),
            fixed.select("block", F.lit(1).alias("side"), "at", "gid", "vec", F.col("to").cast(to).alias("to"), *(null("binary").alias(c) for c in ("ptr", "row", "w", "own"))),
            vectors.select(F.explode("to").alias("t"), "vec").select("t.block", F.lit(2).alias("side"), "t.at", null("long").alias("gid"), "vec", null(to).alias("to"), *(null("binary").alias(c) for c in ("ptr", "row", "w", "own"))),
        ]
        met = sides[0].unionByName(sides[1]).unionByName(sides[2]).repartition(self._width(), "block").sortWithinPartitions("block", "side", "at")
        return met.mapInArrow(lambda it: _multiply(it, mix, mean), f"gid long, vec array<double>, to {to}, change double, size double")

    def product(self, rows: DataFrame) -> DataFrame:
        """A·Z of rows (gid, vec): (gid, vec)."""
        return self.times(self.vectors(rows), self.plain).select("gid", "vec")


class _Block:
    """A block at work: its entries, its rows, and their sums so far."""

    def __init__(self, rows: pa.RecordBatch):
        number = lambda c, t: np.frombuffer(rows.column(c)[0].as_py(), dtype=t)
        self.ptr, self.row, self.w, self.own = number("ptr", np.int64), number("row", np.int32), number("w", np.float64), number("own", np.int32)
        self.nodes: list[pa.RecordBatch] = []
        self.n, self.sum, self.before, self.hits = int((self.own >= 0).sum()), None, None, None

    def add(self, rows: pa.RecordBatch) -> None:
        at, vec = rows.column("at").to_numpy(), rows_of(rows.column("vec"))
        if self.sum is None:
            self.sum, self.before, self.hits = np.zeros((self.n, vec.shape[1])), np.zeros((self.n, vec.shape[1])), np.zeros(self.n, dtype=np.int64)
        own = self.own[at]
        self.before[own[own >= 0]] = vec[own >= 0]
        first, n = self.ptr[at], self.ptr[at + 1] - self.ptr[at]
        which = np.repeat(np.arange(len(at)), n)
        entry = np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        for i in range(0, len(entry), TOGETHER):
            e, v = entry[i : i + TOGETHER], which[i : i + TOGETHER]
            order = np.argsort(self.row[e], kind="stable")
            e, v = e[order], v[order]
            row = self.row[e]
            start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            self.sum[row[start]] += np.add.reduceat(self.w[e, None] * vec[v], start, axis=0)
            self.hits[row[start]] += np.diff(np.append(start, len(row)))

    def rows(self, mix, mean):
        for nodes in self.nodes:
            at, base = nodes.column("at").to_numpy(), nodes.column("vec")
            known = ~np.asarray(base.is_null())
            hits = self.hits[at] if self.hits is not None else np.zeros(len(at), dtype=np.int64)
            keep = np.flatnonzero(known if mix else hits > 0)
            if not len(keep):
                continue
            at, hits = at[keep], hits[keep]
            x = rows_of(base.take(pa.array(keep))) if mix else None
            width = self.sum.shape[1] if self.sum is not None else x.shape[1]
            s = self.sum[at] if self.sum is not None else np.zeros((len(at), width))
            if mean:
                s = s / np.maximum(hits, 1)[:, None]
            new = np.where((hits > 0)[:, None], mix[0] * x + mix[1] * s, mix[2] * x) if mix else s
            before = self.before[at] if self.before is not None else np.zeros_like(new)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(new) + 1) * width, pa.int32()), pa.array(new.ravel()))
            kept = nodes.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column("gid"), vec, kept.column("to"), pa.array(((new - before) ** 2).sum(1)), pa.array((before**2).sum(1))], names=["gid", "vec", "to", "change", "size"])


def _multiply(batches, mix, mean):
    number, block = None, None
    for (b, side), rows in _runs(batches, "block", "side"):
        if b != number:
            if block is not None:
                yield from block.rows(mix, mean)
            number, block = b, _Block(rows)
        elif side == 1:
            block.nodes.append(rows)
        else:
            block.add(rows)
    if block is not None:
        yield from block.rows(mix, mean)
