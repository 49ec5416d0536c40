"""Approximate nearest neighbours by an adaptive dimension scan in probed lists.

1. Rows are dealt to the lists of their nearest centres; the centres come from a bounded
   sample, every row is indexed. Rows are turned by one random rotation, after which any
   first dimensions tell as much about a distance as any others, and are laid down in
   pieces of one list whose turned columns stand in blocks.
2. A query scans its own list first, which gives its first k-th distance. Then it meets
   the other lists it probes. There the distance grows block by block of columns, and a
   candidate is abandoned as soon as a hypothesis test on its partial distance rejects
   that the whole one lies within the k-th; what is left has its exact distance taken on
   the original vectors.
3. How many lists are probed is measured: for a sample of rows the true neighbours are
   found by brute force, and the least number of lists is taken that holds the wanted
   share of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hashed_share, shuffle_width

#: Neighbours, rows at most about that the centres are fitted on, rows whose true neighbours are measured, and the share of those that probed lists must hold.
K, SAMPLE, MEASURED, RECALL = 10, 20_000, 256, 0.97

#: Columns of a block, and the test's width: a greater one abandons later and errs less.
COLUMNS, WIDTH = 16, 2.1

#: Rows of a piece, rows of a group of pieces that one task holds, lists at most, and queries that are scanned at once.
PIECE, GROUP, MOST_LISTS, TOGETHER = 512, 4096, 2048, 64

#: Rounding of single precision, relative to the vectors' lengths.
SLACK = 1e-5


def sound(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): rows whose vector is not null or zero and holds finite components only, and that have an id."""
    v = F.col(f"`{vec_col}`")
    finite = F.forall(v, lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")), F.lit(False)))
    own = F.col(f"`{id_col}`")
    return vectors.filter(v.isNotNull() & own.isNotNull()).filter(finite & F.exists(v, lambda e: e != 0)).select(own.cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows as doubles of one width; shorter rows are filled with zeros, which change no distance."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    n = np.diff(column.offsets.to_numpy())
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    out[np.arange(width)[None, :] < n[:, None]] = flat
    return out


def _rotation(width: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to the centres but for the rows' own lengths; vectors too long for doubles only lose their order."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, nan=0.0)


def _centres(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Centres of about n lists by k-means on the sample, from different rows of it."""
    different = np.unique(sample, axis=0)
    rng = np.random.default_rng(11)
    centres = different[rng.permutation(len(different))[:n]].copy()
    for _ in range(rounds):
        total, count = np.zeros_like(centres), np.zeros(len(centres))
        for i in range(0, len(different), 2048):
            part = different[i : i + 2048]
            own = _gaps(part, centres).argmin(axis=1)
            np.add.at(total, own, part)
            count += np.bincount(own, minlength=len(centres))
        with np.errstate(over="ignore", invalid="ignore"):
            moved = total[count > 0] / count[count > 0, None]
        centres[count > 0] = np.where(np.isfinite(moved), moved, centres[count > 0])
    return centres


class Index:
    """The pieces of all rows, with the centres, the rotation and the lists' groups."""

    def __init__(self, vectors: DataFrame, id_col: str, vec_col: str, group: int = GROUP, piece: int = PIECE, lists: int | None = None, least_width: int = 1):
        spark = self.spark = vectors.sparkSession
        rows = sound(vectors, id_col, vec_col)
        self.kind = "float" if rows.schema["v"].dataType.simpleString() == "array<float>" else "double"
        about = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
        self.n, self.width = about["n"], max(least_width, about["width"] or 0)
        drawn = rows.filter(hashed_share(min(1.0, SAMPLE / max(1, self.n)), "vec_id", "v")).distinct().toArrow()
        sample = _matrix(drawn.column("v").combine_chunks(), self.width) if self.n else np.zeros((0, self.width))
        wanted = lists or min(MOST_LISTS, round(math.sqrt(self.n)))
        self.centres = _centres(sample, max(1, min(wanted, len(sample) // 4))) if len(sample) else np.zeros((1, self.width))
        self.shared = spark.sparkContext.broadcast((self.centres, _rotation(self.width), self.width))
        self.placed = placed = cut(self._placed(rows))
        group = max(piece, min(group, math.ceil(self.n / shuffle_width(spark))))  # few rows are spread over the tasks there are
        self.first, self.parts, self.groups = self._groups({r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}, group)
        self.pieces = cut(self._laid(placed, piece))

    def _placed(self, rows: DataFrame) -> DataFrame:
        shared, dtype = self.shared, np.float32 if self.kind == "float" else np.float64

        def place(batches):
            centres, _, width = shared.value
            for batch in batches:
                if batch.num_rows:
                    v = _matrix(batch.column("v"), width)
                    own = _gaps(v, centres).argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own, pa.int32()), pa.array([x.tobytes() for x in v.astype(dtype)], pa.binary())], names=["vec_id", "list", "v"])

        return rows.mapInArrow(place, "vec_id long, list int, v binary")

    def _groups(self, counts: dict, most: int) -> tuple[np.ndarray, np.ndarray, int]:
        """First group and number of groups of each list: following lists share one of about `most` rows, a list of more is spread over several."""
        first, parts = np.zeros(len(self.centres), dtype=np.int32), np.ones(len(self.centres), dtype=np.int32)
        group, room = 0, most
        for i, n in sorted(counts.items()):
            if n > room and room < most:
                group, room = group + 1, most
            first[i], parts[i] = group, max(1, math.ceil(n / most))
            if parts[i] > 1:
                group, room = group + int(parts[i]), most
            else:
                room -= n
        return first, parts, group + 1

    def _laid(self, placed: DataFrame, piece: int) -> DataFrame:
        """(g, list, ids, v, turned): pieces of one list each, original rows and turned columns, a column's numbers next to each other."""
        shared, dtype = self.shared, np.float32 if self.kind == "float" else np.float64
        where = F.broadcast(self.spark.createDataFrame(pa.table({"list": pa.array(range(len(self.centres)), pa.int32()), "first": self.first, "parts": self.parts})))  # a row for each list at most
        dealt = placed.join(where, "list").withColumn("g", (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).cast("int"))

        def lay(batches):
            _, turn, width = shared.value
            held: list[pa.RecordBatch] = []

            def flush():
                table = pa.Table.from_batches(held)
                v = np.frombuffer(b"".join(table.column("v").to_pylist()), dtype=dtype).reshape(-1, width)
                with np.errstate(over="ignore", invalid="ignore"):
                    turned = np.ascontiguousarray((v.astype(np.float64) @ turn).T.astype(np.float32))
                key = [table.column(c)[0].as_py() for c in ("g", "list")]
                cols = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (table.column("vec_id").to_numpy(), v, turned))]
                held.clear()
                return pa.RecordBatch.from_arrays(cols, names=["g", "list", "ids", "v", "turned"])

            current, n = None, 0
            for batch in batches:
                keys = list(zip(batch.column("g").to_pylist(), batch.column("list").to_pylist()))
                start = 0
                while start < len(keys):
                    end = start
                    while end < len(keys) and keys[end] == keys[start] and end - start < piece:
                        end += 1
                    if held and (keys[start] != current or n + end - start > piece):
                        yield flush()
                        n = 0
                    current, n = keys[start], n + end - start
                    held.append(batch.slice(start, end - start))
                    start = end
            if held:
                yield flush()

        width = max(shuffle_width(self.spark), self.groups)
        laid = dealt.select("g", "list", "vec_id", "v").repartition(width, "g").sortWithinPartitions("g", "list", "vec_id", "v")
        return laid.mapInArrow(lay, "g int, list int, ids binary, v binary, turned binary")

    def order(self, v: np.ndarray) -> np.ndarray:
        """All lists for each row, the nearest first."""
        return np.argsort(_gaps(v, self.centres), axis=1, kind="stable")


def _kth(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k least (distance, id)."""
    if len(d) > 4 * k:
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        return near[np.lexsort((ids[near], d[near]))[:k]]
    return np.lexsort((ids, d))[:k]


def _scan(q: np.ndarray, turned_q: np.ndarray, kth: np.ndarray, rows: np.ndarray, turned: np.ndarray, scanned: np.ndarray):
    """(query, row, distance) of the pairs that no test abandons. scanned counts the pairs at each block of columns."""
    width = turned_q.shape[1]
    slack = SLACK * np.sqrt((turned_q.astype(np.float64) ** 2).sum(axis=1))
    bound = lambda d: (kth * math.sqrt(d / width) * (1 + (WIDTH / math.sqrt(d) if d < width else 0)) + slack) ** 2
    at = min(COLUMNS, width)
    part = np.zeros((len(q), turned.shape[1]), dtype=np.float32)
    for c in range(at):
        part += (turned_q[:, c, None] - turned[None, c]) ** 2
    scanned[0] += part.size
    i, j = np.nonzero(~(part > bound(at)[:, None]))
    part = part[i, j]
    while at < width and len(i):
        end = min(at + COLUMNS, width)
        part = part + ((turned_q[i, at:end] - turned[at:end, j].T) ** 2).sum(axis=1)
        scanned[at // COLUMNS] += len(i)
        keep = ~(part > bound(end)[i])
        i, j, part, at = i[keep], j[keep], part[keep], end
    out = np.empty(len(i))
    for s in range(0, len(i), 4096):
        out[s : s + 4096] = np.sqrt(((q[i[s : s + 4096]] - rows[j[s : s + 4096]].astype(np.float64)) ** 2).sum(axis=1))
    return i, j, out


def _search(batches, shared, kind, k):
    """Pieces of a group come first, then its queries in any number: each batch of them is scanned and forgotten."""
    _, turn, width = shared.value
    dtype = np.float32 if kind == "float" else np.float64
    group, pieces = None, []
    for batch in batches:
        sides, groups = batch.column("side").to_pylist(), batch.column("g").to_pylist()
        asked: list[int] = []
        for at, (side, g) in enumerate(zip(sides, groups)):
            if g != group:
                if asked:
                    yield from _answers(batch, asked, pieces, turn, width, k)
                    asked = []
                group, pieces = g, []
            if side == 0:
                ids = np.frombuffer(batch.column("ids")[at].as_py(), dtype=np.int64)
                pieces.append((batch.column("list")[at].as_py(), ids, np.frombuffer(batch.column("v")[at].as_py(), dtype=dtype).reshape(len(ids), width), np.frombuffer(batch.column("turned")[at].as_py(), dtype=np.float32).reshape(width, len(ids))))
            else:
                asked.append(at)
        if asked:
            yield from _answers(batch, asked, pieces, turn, width, k)


def _answers(batch, asked, pieces, turn, width, k):
    for low in range(0, len(asked), TOGETHER):
        at = pa.array(asked[low : low + TOGETHER])
        part = batch.take(at)
        names = part.column("query_id").to_numpy()
        q = np.frombuffer(b"".join(part.column("v").to_pylist()), dtype=np.float64).reshape(-1, width)
        probes = np.stack([np.unpackbits(np.frombuffer(x, dtype=np.uint8)) for x in part.column("ids").to_pylist()]).astype(bool)
        kth = part.column("kth").to_numpy().copy()
        with np.errstate(over="ignore", invalid="ignore"):
            turned_q = (q @ turn).astype(np.float32)
            found = [(np.zeros(0), np.zeros(0, dtype=np.int64)) for _ in names]
            blocks = np.zeros(math.ceil(width / COLUMNS), dtype=np.int64)
            for number, ids, rows, turned in pieces:
                who = np.flatnonzero(probes[:, number])
                if not len(who):
                    continue
                i, j, d = _scan(q[who], turned_q[who], kth[who], rows, turned, blocks)
                for own in np.unique(i):
                    w, hit = who[own], i == own
                    hit &= ids[j] != names[w]
                    dd, ii = np.concatenate([found[w][0], d[hit]]), np.concatenate([found[w][1], ids[j[hit]]])
                    best = _kth(dd, ii, k)
                    found[w] = (dd[best], ii[best])
                    if len(best) == k:
                        kth[w] = min(kth[w], dd[best[-1]])
        n = [len(x[0]) for x in found]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n), pa.int64()), pa.array(np.concatenate([x[1] for x in found]), pa.int64()), pa.array(np.concatenate([x[0] for x in found]), pa.float64())], names=["query_id", "vec_id", "score"])


def _found(index: Index, routed: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each query and group that it is sent to, at most k candidates. routed has (query_id, v, kth, g, ids): ids are the probed lists as bits."""
    null = lambda t: F.lit(None).cast(t)
    p = index.pieces.select("g", F.lit(0).alias("side"), "list", "ids", "v", "turned", null("long").alias("query_id"), null("double").alias("kth"))
    q = routed.select("g", F.lit(1).alias("side"), null("int").alias("list"), "ids", "v", null("binary").alias("turned"), "query_id", "kth")
    shared, kind = index.shared, index.kind
    width = max(shuffle_width(index.spark), index.groups)
    return p.unionByName(q).repartition(width, "g").sortWithinPartitions("g", "side").mapInArrow(lambda it: _search(it, shared, kind, k), "query_id long, vec_id long, score double")


def _routed(index: Index, asked: DataFrame, low: int, high: int) -> DataFrame:
    """Each query once for every group that holds one of its lists from the low-th nearest up to the high-th."""
    shared, first, parts, lists = index.shared, index.first, index.parts, len(index.centres)

    def route(batches):
        centres, _, width = shared.value
        for batch in batches:
            names, vs, bits, gs, kths = [], [], [], [], []
            v = np.frombuffer(b"".join(batch.column("v").to_pylist()), dtype=np.float64).reshape(-1, width)
            near = np.argsort(_gaps(v, centres), axis=1, kind="stable")[:, low:high] if len(v) else []
            for i, own in enumerate(near):
                where = np.zeros(lists, dtype=np.uint8)
                where[own] = 1
                to = np.unique(np.concatenate([np.arange(first[x], first[x] + parts[x]) for x in own])) if len(own) else []
                names += [batch.column("query_id")[i].as_py()] * len(to)
                vs += [v[i].tobytes()] * len(to)
                kths += [batch.column("kth")[i].as_py()] * len(to)
                bits += [np.packbits(where).tobytes()] * len(to)
                gs += [int(x) for x in to]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(vs, pa.binary()), pa.array(kths, pa.float64()), pa.array(gs, pa.int32()), pa.array(bits, pa.binary())], names=["query_id", "v", "kth", "g", "ids"])

    return asked.mapInArrow(route, "query_id long, v binary, kth double, g int, ids binary")


def _true(index: Index, names: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(query, list) of each of the k nearest rows of the given queries, by brute force over all rows."""
    shared, kind = index.spark.sparkContext.broadcast((names, q)), index.kind

    def nearest(batches):
        names, q = shared.value
        dtype, width = np.float32 if kind == "float" else np.float64, q.shape[1]
        found = [(np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)) for _ in names]
        for batch in batches:
            for number, ids, v in zip(batch.column("list").to_pylist(), batch.column("ids").to_pylist(), batch.column("v").to_pylist()):
                ids, v = np.frombuffer(ids, dtype=np.int64), np.frombuffer(v, dtype=dtype).reshape(-1, width).astype(np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    gaps = np.nan_to_num((v**2).sum(axis=1)[None, :] + (q**2).sum(axis=1)[:, None] - 2 * q @ v.T, nan=np.inf)
                for i, name in enumerate(names):
                    other = np.flatnonzero(ids != name)
                    other = other[_kth(gaps[i, other], ids[other], k)]
                    dd, ii = np.concatenate([found[i][0], gaps[i, other]]), np.concatenate([found[i][1], ids[other]])
                    nn = np.concatenate([found[i][2], np.full(len(other), number, dtype=np.int32)])
                    best = _kth(dd, ii, k)
                    found[i] = (dd[best], ii[best], nn[best])
        n = [len(x[0]) for x in found]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(names)), n), pa.int32()), *(pa.array(np.concatenate([x[c] for x in found]), t) for c, t in ((0, pa.float64()), (1, pa.int64()), (2, pa.int32())))], names=["q", "d", "vec_id", "list"])

    best = Window.partitionBy("q").orderBy("d", "vec_id")
    all_found = index.pieces.select("list", "ids", "v").mapInArrow(nearest, "q int, d double, vec_id long, list int")
    return [(r["q"], r["list"]) for r in all_found.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k).select("q", "list").collect()]


def probes_for(index: Index, k: int, recall: float, measured: int = MEASURED) -> int:
    """The least number of nearest lists that hold so large a share of the true k nearest of a sample of about `measured` rows."""
    if not index.n or len(index.centres) == 1:
        return len(index.centres)
    dtype = np.float32 if index.kind == "float" else np.float64
    rows = index.placed.filter(hashed_share(min(1.0, measured / index.n), "vec_id", "v")).select("vec_id", "v").distinct().toArrow()
    if not rows.num_rows:
        return len(index.centres)
    names = rows.column("vec_id").to_numpy()
    q = np.frombuffer(b"".join(rows.column("v").to_pylist()), dtype=dtype).reshape(-1, index.width).astype(np.float64)
    rank = np.argsort(index.order(q), axis=1)
    at = np.sort([rank[i, x] for i, x in _true(index, names, q, k)])
    return int(at[max(0, math.ceil(recall * len(at)) - 1)]) + 1 if len(at) else len(index.centres)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, probes: int | None = None, lists: int | None = None) -> DataFrame:
    """The k nearest found candidates of each query by Euclidean distance.

    Candidates are all rows of `vectors` but those with the query's own id; ties go to
    the smaller id. Rows that lack an id, are null or zero or hold null or non-finite
    components take no part. Shorter vectors are filled with zeros. Distances are taken
    on the original vectors in double precision (beyond their range they are infinite).
    A repeated id stays several candidates but is one query (its least vector). A query
    that finds fewer than k in the probed lists scans all others, so it gets k, or all
    candidates if there are fewer.

    recall is the share of true neighbours that probed lists must hold on a measured
    sample, unless `probes` gives their number; with all lists probed only the tests can
    lose a neighbour.

    Returns (query_id, rank, vec_id, score).
    """
    ahead = sound(queries, id_col, vec_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    index = Index(vectors, id_col, vec_col, lists=lists, least_width=ahead.agg(F.max(F.size("v"))).first()[0] or 1)
    lists = len(index.centres)
    probes = min(lists, probes or probes_for(index, k, recall))
    width = index.width

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x.tobytes() for x in _matrix(batch.column("v"), width)], pa.binary())], names=["query_id", "v"])

    asked = cut(ahead.mapInArrow(pack, "query_id long, v binary"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    kth = lambda found: found.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("score")).alias("kth"), F.count("*").alias("n"))
    held = lambda found: asked.join(kth(found), "query_id", "left").withColumns({"kth": F.coalesce("kth", F.lit(float("inf"))), "n": F.coalesce("n", F.lit(0))})
    first = cut(ranked(_found(index, _routed(index, asked.withColumn("kth", F.lit(float("inf"))), 0, 1), k)).drop("rank"))
    out = first
    if probes > 1:
        more = _found(index, _routed(index, held(first).drop("n"), 1, probes), k)
        out = cut(ranked(first.unionByName(more)).drop("rank"))
    if probes < lists:
        short = held(out).filter(F.col("n") < min(k, index.n)).drop("n")
        if short.limit(1).count():
            out = out.unionByName(_found(index, _routed(index, short, probes, lists), k))
    return ranked(out).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
