"""Exact top-k inner products by block-at-a-time pruning.

Candidates that look alike are laid out in blocks; each block keeps its forward index
(the integer rows) and, for every dimension, its greatest and least weight. A query's
bound on a block is the sum over dimensions of the best product those extremes allow.
Every query first visits the blocks around its own place, which gives its first k-th
score. Bounds of all other blocks, which are small beside them, are then held against
it, and only the blocks that reach it are sent to the query. Wherever a query meets
several blocks it visits them by falling bound and ends where bounds fall below its
k-th score so far.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_width

#: Candidate rows in a block and in a group of blocks that one task holds, queries in a group, and blocks whose bounds one task holds.
BLOCK, GROUP, QUERIES, BOUNDS = 512, 8192, 1024, 4096

#: Rows, chosen by hash, whose neighbourhoods the layout follows. They only decide what stands together.
PIVOTS = 512

#: Beyond this, sums of products may be rounded in doubles.
EXACT = 2.0**53

#: Rows of what tasks are given: a query (side 0) or a block (side 1).
_SIDES = "qb int, g int, side int, id long, width int, v binary, floor double, ids binary, top binary, low binary"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x), without rows that are null, hold null or non-finite components, or lack an id."""
    x = F.transform(vec_col, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("double"))
    sound = F.forall(vec_col, lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")), F.lit(False)))
    return vectors.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).filter(sound).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows as doubles; shorter rows are filled with zeros, which change no inner product."""
    lists = column.to_pylist()
    width = max(map(len, lists), default=0)
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: in doubles while all partial sums stay below 2**53, else in Python integers."""
    n = min(q.shape[1], c.shape[1])
    q, c = q[:, :n], c[:, :n]
    if n == 0 or n * np.abs(q).max(initial=0) * np.abs(c).max(initial=0) < EXACT:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], dtype=object)
    return whole(q) @ whole(c).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest scores, ties to the lesser id."""
    return np.lexsort((ids, -scores))[:k]


class _Top:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int, floors: np.ndarray):
        self.k, self.found, self.kth = k, [([], []) for _ in range(n)], floors.astype(np.float64)

    def add(self, i: int, scores, ids) -> None:
        keep = scores >= self.kth[i]
        if not keep.any():
            return
        s = np.concatenate([np.array(self.found[i][0], dtype=scores.dtype), scores[keep]])
        d = np.concatenate([np.array(self.found[i][1], dtype=np.int64), ids[keep]])
        order = _best(s, d, self.k)
        self.found[i] = (s[order], d[order])
        if len(order) == self.k and scores.dtype != object:  # beyond doubles a threshold would be rounded: nothing is skipped
            self.kth[i] = max(self.kth[i], float(s[order[-1]]))


def _visit(query_ids, q, floors, blocks, k):
    """Score one block of queries against blocks [(ids, rows, top, low)], each query by its own order of bounds."""
    wide = q.shape[1] * np.abs(q).max(initial=0) * max((np.abs(b[1]).max(initial=0) for b in blocks), default=0) >= EXACT
    top = _Top(len(query_ids), k, np.full(len(query_ids), -np.inf) if wide else floors)
    positive, negative = np.maximum(q, 0), np.minimum(q, 0)
    fit = lambda m: np.pad(m, (0, max(0, q.shape[1] - len(m))))[: q.shape[1]]
    bounds = np.stack([positive @ fit(b[2]) + negative @ fit(b[3]) for b in blocks], axis=1)
    order = np.argsort(-bounds, axis=1, kind="stable")
    alive = np.arange(len(query_ids))
    for step in range(len(blocks)):
        chosen = order[alive, step]
        alive = alive[bounds[alive, chosen] >= top.kth[alive]]  # later bounds are no greater: a query that fails here is done
        if not len(alive):
            break
        chosen = order[alive, step]
        for b in np.unique(chosen):
            who = alive[chosen == b]
            ids, rows = blocks[b][0], blocks[b][1]
            scores = _products(q[who], rows)
            for j, i in enumerate(who):
                other = ids != query_ids[i]
                top.add(i, scores[j][other], ids[other])
    return top.found


def _group_rows(batches, keys):
    """Consecutive rows with equal keys, as one Arrow table each. Rows come sorted by keys."""
    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        start = 0
        for i in range(1, len(cols) + 1):
            if i == len(cols) or cols[i] != cols[start]:
                if held and current != cols[start]:
                    yield current, pa.Table.from_batches(held)
                    held = []
                current = cols[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield current, pa.Table.from_batches(held)


def _numbers(x: bytes, width: int | None = None) -> np.ndarray:
    out = np.frombuffer(x, dtype=np.float64)
    return out if width is None else out.reshape(-1, width)


def _batch(schema: str, columns: dict, n: int) -> pa.RecordBatch:
    """A record batch of the schema's columns; what is not given is null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[f], kinds[k]) if f in columns else pa.nulls(n, kinds[k]) for f, k in fields], names=[f for f, _ in fields])


def _pivots(rows: DataFrame, n: int) -> np.ndarray:
    """About PIVOTS different rows, each next to the one it resembles most among the rest."""
    space = 1_000_000_000
    sample = rows.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(space)) < math.ceil(space * PIVOTS / max(1, n))).select("vec_id", "v").distinct().toArrow()
    v = _matrix(sample.column("v"))[np.argsort(sample.column("vec_id").to_numpy(), kind="stable")]
    left, order = list(range(len(v))), []
    while left:
        last = v[order[-1]] if order else v[left[0]]
        gap = ((v[left] - last) ** 2).sum(axis=1)
        order.append(left.pop(int(gap.argmin())))
    return v[order]


def _placed(rows: DataFrame, pivots) -> DataFrame:
    """(vec_id, v, cell, near): the nearest pivot of each row and how far it is."""

    def place(batches):
        c = pivots.value
        for batch in batches:
            v = _matrix(batch.column("v"))
            if not len(v):
                continue
            w = max(v.shape[1], c.shape[1])
            x, y = np.pad(v, ((0, 0), (0, w - v.shape[1]))), np.pad(c, ((0, 0), (0, w - c.shape[1])))
            with np.errstate(over="ignore", invalid="ignore"):  # of vectors that are too long for doubles only the order in blocks suffers
                gap = np.nan_to_num((y**2).sum(axis=1)[None, :] - 2 * x @ y.T, nan=0.0)
                cell, size = gap.argmin(axis=1), np.nan_to_num((x**2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(size + gap[np.arange(len(x)), cell])], names=["vec_id", "v", "cell", "near"])

    return rows.mapInArrow(place, "vec_id long, v array<double>, cell int, near double")


def _dealt(placed: DataFrame, most: int, name: str) -> tuple[DataFrame, int]:
    """Rows with a group of about `most` rows: consecutive cells share one, a cell with more is spread over several by hash."""
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # a row for each pivot at most
    table, group, room = [], 0, most
    for cell, n in sorted(counts.items()):
        if n > room and room < most:
            group, room = group + 1, most
        parts = max(1, math.ceil(n / most))
        table.append((cell, group, parts))
        if parts > 1:
            group, room = group + parts, most
        else:
            room -= n
    where = F.broadcast(placed.sparkSession.createDataFrame(table, "cell int, first int, parts int"))
    return placed.join(where, "cell").withColumn(name, (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).cast("int")).drop("first", "parts"), group + 1


def _blocks(dealt: DataFrame, groups: int, block: int) -> DataFrame:
    """(g, b, width, ids, rows, top, low): the candidates in blocks, cut in the shared folder."""
    spark = dealt.sparkSession

    def build(batches):
        for (g,), table in _group_rows(batches, ["g"]):
            for i, start in enumerate(range(0, table.num_rows, block)):
                part = table.slice(start, block)
                v = _matrix(part.column("v"))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([g], pa.int32()),
                        pa.array([(g << 24) + i], pa.int64()),
                        pa.array([v.shape[1]], pa.int32()),
                        *(pa.array([x.tobytes()], pa.binary()) for x in (part.column("vec_id").to_numpy(), v, v.max(axis=0), v.min(axis=0))),
                    ],
                    names=["g", "b", "width", "ids", "rows", "top", "low"],
                )

    laid = dealt.select("g", "cell", "near", "vec_id", "v").repartition(max(shuffle_width(spark), groups), "g").sortWithinPartitions("g", "cell", "near", "vec_id")
    return cut(laid.mapInArrow(build, "g int, b long, width int, ids binary, rows binary, top binary, low binary"))


def _met(asked: DataFrame, wanted: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of at most k candidates for each query and group: asked has (qb, g, vec_id, v, floor), wanted (qb, g, b)."""
    q = asked.select("qb", "g", F.lit(0).alias("side"), F.col("vec_id").alias("id"), F.lit(0).alias("width"), "v", "floor", *(F.lit(None).cast("binary").alias(c) for c in ("ids", "top", "low")))
    c = wanted.join(blocks.drop("g"), "b").select("qb", "g", F.lit(1).alias("side"), F.col("b").alias("id"), "width", F.col("rows").alias("v"), F.lit(None).cast("double").alias("floor"), "ids", "top", "low")

    def score(batches):
        for _, table in _group_rows(batches, ["qb", "g"]):
            rows = table.to_pylist()
            own = [r for r in rows if r["side"] == 0]
            held = [(np.frombuffer(r["ids"], dtype=np.int64), _numbers(r["v"], r["width"]) if r["width"] else np.zeros((len(r["ids"]) // 8, 0)), _numbers(r["top"]), _numbers(r["low"])) for r in rows if r["side"] == 1]
            if not own or not held:
                continue
            width = max(len(r["v"]) for r in own) // 8
            v = np.stack([np.pad(_numbers(r["v"]), (0, width - len(r["v"]) // 8)) for r in own])
            ids = np.array([r["id"] for r in own], dtype=np.int64)
            found = _visit(ids, v, np.array([r["floor"] for r in own]), held, k)
            limit = 10**38 - 1
            out = [(int(ids[i]), int(d), min(max(int(s), -limit), limit)) for i, (ss, dd) in enumerate(found) for s, d in zip(ss, dd)]
            kinds = (pa.int64(), pa.int64(), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names=["query_id", "vec_id", "score"])

    width = shuffle_width(asked.sparkSession)
    return q.unionByName(c).repartition(width, "qb", "g").sortWithinPartitions("qb", "g", "side", "id").mapInArrow(score, "query_id long, vec_id long, score decimal(38,0)")


def _alive(asked: DataFrame, blocks: DataFrame, query_groups: int, n_blocks: int) -> DataFrame:
    """Rows of _SIDES: the queries and the blocks of each pair of groups in which some bound reaches a query's floor.

    asked has (qb, home, vec_id, v, floor); a query has been in its home group before. For a
    block, `width` is the number of its queries.
    """
    parts = max(1, math.ceil(n_blocks / BOUNDS))
    q = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("qb", "part", F.lit(0).alias("side"), F.col("vec_id").alias("id"), F.col("home").alias("g"), "v", "floor", F.lit(None).cast("binary").alias("low"))
    c = blocks.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(parts)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))))
    c = c.select("qb", "part", F.lit(1).alias("side"), F.col("b").alias("id"), "g", F.col("top").alias("v"), F.lit(None).cast("double").alias("floor"), "low")

    def bound(batches):
        for (qb, _), table in _group_rows(batches, ["qb", "part"]):
            rows = table.to_pylist()
            own, held = ([r for r in rows if r["side"] == i] for i in (0, 1))
            if not own or not held:
                continue
            width = max(len(r["v"]) for r in rows) // 8
            fit = lambda x: np.pad(_numbers(x), (0, width - len(x) // 8))
            v, top, low = (np.stack([fit(r[c]) for r in part]) for part, c in ((own, "v"), (held, "v"), (held, "low")))
            floor, home = np.array([r["floor"] for r in own]), np.array([r["g"] for r in own])
            g = np.array([r["g"] for r in held])
            with np.errstate(over="ignore", invalid="ignore"):
                bounds = np.maximum(v, 0) @ top.T + np.minimum(v, 0) @ low.T
                wide = width * np.abs(v).max(initial=0) * max(np.abs(top).max(initial=0), np.abs(low).max(initial=0)) >= EXACT
            reach = np.ones_like(bounds, dtype=bool) if wide else bounds >= floor[:, None]
            reach &= home[:, None] != g[None, :]
            hit = np.flatnonzero(reach.any(axis=0))
            yield _batch(_SIDES, {"qb": [qb] * len(hit), "g": g[hit], "side": [1] * len(hit), "id": [held[j]["id"] for j in hit], "width": reach[:, hit].sum(axis=0)}, len(hit))
            for each in np.unique(g[hit]):
                who = np.flatnonzero(reach[:, g == each].any(axis=1))
                yield _batch(_SIDES, {"qb": [qb] * len(who), "g": [each] * len(who), "side": [0] * len(who), "id": [own[i]["id"] for i in who], "v": [own[i]["v"] for i in who], "floor": floor[who]}, len(who))

    width = shuffle_width(asked.sparkSession)
    return q.unionByName(c).repartition(width, "qb", "part").sortWithinPartitions("qb", "part", "side", "id").mapInArrow(bound, _SIDES)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, block: int = BLOCK, group: int = GROUP
) -> DataFrame:
    """The k candidates with the greatest integer inner product for each query, exactly.

    Components become floor(scale * x). Candidates are all rows of `vectors` but those
    with the query's own id; ties go to the smaller id. Rows that lack an id, are null
    or hold null or non-finite components take no part. Vectors of different lengths
    are compared over their common components. Scores are exact integers and ranked as
    such up to 38 digits; the column is a long, and a score out of its range is shown as
    the range's end. A repeated id stays several candidates but is one query (its least
    vector). A query with fewer than k candidates gets all. Blocks hold `block` rows and
    a task about `group` of them; neither changes the result.

    Returns (query_id, rank, vec_id, score).
    """
    return _searched(vectors, queries, k, id_col, vec_col, scale, block, group)[0]


def _searched(vectors, queries, k, id_col, vec_col, scale, block, group) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The answer, the pairs of groups that bounds let through, and the blocks."""
    spark = vectors.sparkSession
    rows = cut(quantised(vectors, id_col, vec_col, scale))
    n_rows = rows.count()
    group = max(block, min(group, math.ceil(n_rows / shuffle_width(spark))))  # few rows are spread over the tasks there are
    pivots = spark.sparkContext.broadcast(_pivots(rows, n_rows))
    placed = cut(_placed(rows, pivots))
    dealt, groups = _dealt(placed, group, "g")
    blocks = _blocks(dealt, groups, block)
    n_blocks = blocks.count()
    asked = quantised(queries, id_col, vec_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    end = 2**63 - 1
    shown = F.least(F.greatest(F.col("score"), F.lit(-end - 1)), F.lit(end)).cast("long").alias("score")
    answer = lambda found: ranked(found).select("query_id", "rank", "vec_id", shown)
    # queries stand in groups of neighbours, and each at home in a group of blocks: the first one of their cell
    grouped, query_groups = _dealt(cut(_placed(asked, pivots)), QUERIES, "qb")
    packed = _packed(grouped.select("qb", "cell", "vec_id", "v"))
    homes = dealt.groupBy("cell").agg(F.min("g").alias("home"))
    asked = cut(packed.join(F.broadcast(homes), "cell", "left").withColumn("home", F.coalesce("home", F.lit(0))))  # a row for each pivot at most
    first = cut(_met(asked.select("qb", F.col("home").alias("g"), "vec_id", "v", F.lit(float("-inf")).alias("floor")), asked.select("qb", F.col("home").alias("g")).distinct().join(blocks.select("g", "b"), "g"), blocks, k))
    if not n_blocks:
        return answer(first), None, blocks
    floors = ranked(first).groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") == k, F.min("score").cast("double")).alias("floor"))
    asked = asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    alive = cut(_alive(asked, blocks, query_groups, n_blocks))
    more = _met(alive.filter("side = 0").select("qb", "g", F.col("id").alias("vec_id"), "v", "floor"), alive.filter("side = 1").select("qb", "g", F.col("id").alias("b")), blocks, k)
    return answer(first.unionByName(more)), alive, blocks


def _packed(rows: DataFrame) -> DataFrame:
    """v as bytes of doubles."""
    names = rows.columns

    def pack(batches):
        for batch in batches:
            own = [batch.column(c) for c in names if c != "v"]
            yield pa.RecordBatch.from_arrays([*own, pa.array([np.array(x.as_py(), dtype=np.float64).tobytes() for x in batch.column("v")], pa.binary())], names=[*(c for c in names if c != "v"), "v"])

    return rows.mapInArrow(pack, ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "v") + ", v binary")
