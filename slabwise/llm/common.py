"""Small pieces that several operators share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slabwise.session import cut, shuffle_width

__all__ = ["cut", "shuffle_width", "table", "held_out", "sigmoid", "mix64", "Memo", "connected_components", "filter_rows", "fresh", "hashed_share", "rows_with_keys", "salted_join", "slices", "texts"]

#: Keys of 16 bytes that are sent to every task; beyond, rows and keys are shuffled. The rows that pass are the same.
BROADCAST_KEYS = 1_000_000

#: Edges that one task takes in when components are finished; beyond, all executors contract them by rounds first.
EDGES_OF_A_TASK = 400_000

#: Parts into which the rows of one key are dealt before a join on it.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose crc32 of the id as text is 2 modulo 4; a null id is not held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


class Memo(dict):
    """A dictionary that computes missing values and starts afresh beyond `limit` entries."""

    def __init__(self, compute, limit: int = 120_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def slices(batches, rows: int = 512):
    """Batches cut to a bounded number of rows, so that what is made of one stays small beside it."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def texts(column) -> Iterator[str]:
    """The strings of an Arrow column one by one, null as empty."""
    for x in column:
        yield x.as_py() or ""


def filter_rows(docs: DataFrame, text_col: str, make_keep) -> DataFrame:
    """The rows whose text passes: make_keep() is called once in a task and gives keep(list of texts, null as empty) -> booleans.

    Rows pass through whole, so nothing is joined or shuffled and no column is looked at but the text.
    """
    place = docs.columns.index(text_col)

    def run(batches):
        keep = make_keep()
        for batch in slices(batches):
            yield batch.filter(pa.array(keep(list(texts(batch.column(place)))), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def hashed_share(share: float, *columns: str | Column) -> Column:
    """Whether a hash of the columns is among that share of all hashes: a sample that is made within each task."""
    space = 1_000_000_000
    return F.pmod(F.xxhash64(*columns), F.lit(space)) < F.lit(min(space, math.ceil(space * share)))


def fresh(columns: list[str], name: str) -> str:
    """A column name like `name` that none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _halves(keys: np.ndarray | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def rows_with_keys(docs: DataFrame, key: Column, keys: DataFrame, keep: bool = True, most: int = BROADCAST_KEYS) -> DataFrame:
    """The rows of docs whose key, 16 bytes and never null, is among `keys` (or with keep=False: is not), whole.

    keys has one column, is distinct and already materialised. Up to `most` of them are
    sent to the tasks, so that no row of docs is shuffled; more are joined.
    """
    name = fresh(docs.columns, "key")
    keyed, own = docs.withColumn(name, key), [F.col(f"`{c}`") for c in docs.columns]
    keys = keys.toDF(name)
    if keys.limit(most + 1).count() > most:
        return keyed.join(keys, name, "left_semi" if keep else "left_anti").select(*own)
    high, low = _halves(keys.toArrow().column(0).to_pylist())
    order = np.lexsort((low, high))
    shared = docs.sparkSession.sparkContext.broadcast((high[order], low[order]))
    schema = docs.schema

    def run(batches):
        high, low = shared.value
        repeats = int(np.unique(high, return_counts=True)[1].max(initial=0))
        for batch in slices(batches):
            at = batch.num_columns - 1
            a, b = _halves(batch.column(at).to_pylist())
            found, first = np.zeros(len(a), dtype=bool), np.searchsorted(high, a)
            for i in range(repeats):  # two keys with equal first halves are next to each other
                place = np.minimum(first + i, len(high) - 1)
                found |= (high[place] == a) & (low[place] == b)
            rows = pa.RecordBatch.from_arrays(batch.columns[:at], names=batch.schema.names[:at])
            yield rows.filter(pa.array(found == keep))

    return keyed.mapInArrow(run, schema)


def salted_join(rows: DataFrame, few: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join (inner or left) on a key of which one may hold a third of rows; few has one row for each key and is repeated for each salt."""
    salt = fresh([*rows.columns, *few.columns], "salt")
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.lit(SALTS)).cast("int"))
    each = few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(each, [on, salt], how).drop(salt)


def _components(batches):
    """Label the nodes of all edges (u, v) that one task holds by hooking and pointer jumping on their numbers."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    edges = pa.Table.from_batches(held)
    ends = pa.concat_arrays([*edges.column("u").chunks, *edges.column("v").chunks])
    coded = ends.dictionary_encode()
    number, nodes = coded.indices.to_numpy(), coded.dictionary
    u, v = number[: edges.num_rows].astype(np.int64), number[edges.num_rows :].astype(np.int64)
    label = np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(u, v), np.maximum(u, v)
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
        u, v = label[u], label[v]
        apart = u != v
        u, v = u[apart], v[apart]
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], names=["node", "label"])


def connected_components(edges: DataFrame, most: int = EDGES_OF_A_TASK) -> DataFrame:
    """Label every node of an undirected edge list (u, v) with a node of its component, the same for all of them.

    Each round hooks every node to its least neighbour, if that is less than itself,
    follows the hooks to their ends, and puts the ends in the edges' place; edges that
    become loops go, so what is left shrinks by half at least in each round. The least
    neighbour of a hub is found by a grouped minimum that is aggregated before the
    shuffle, and each round is cut in the shared checkpoint folder. When no more than
    `most` edges are left, one task finishes them. Returns (node, label); nodes without
    an edge do not appear.
    """
    kind = edges.schema["u"].dataType.simpleString()
    left = cut(edges.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = None
    while True:
        n = left.limit(most + 1).count()
        if n <= most:
            hooks = cut(left.repartition(1).mapInArrow(_components, f"node {kind}, label {kind}")).select("node", F.col("label").alias("to"))
        else:
            ends = left.select(F.col("u").alias("a"), F.col("v").alias("b")).union(left.select(F.col("v").alias("a"), F.col("u").alias("b")))
            hooks = cut(ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")))
            while True:  # pointers of pointers, until all are ends
                jump = hooks.select(F.col("node").alias("to"), F.col("to").alias("end"))
                stepped = cut(salted_join(hooks, jump, "to").select("node", F.col("to").alias("old"), F.col("end").alias("to")))
                moved = stepped.filter(F.col("to") != F.col("old")).limit(1).count()
                hooks = stepped.select("node", "to")
                if not moved:
                    break
        if labels is None:
            labels = hooks.select("node", F.col("to").alias("label"))
        elif n:
            # a label whose component is whole has no edge left, so it isn't among the hooks
            step = hooks.select(F.col("node").alias("label"), F.col("to").alias("end"))
            moved = salted_join(labels, step, "label").select("node", F.col("end").alias("label"))
            labels = cut(labels.join(moved.select("node"), "node", "left_anti").unionByName(moved))
        if n <= most:
            return labels
        at_u, at_v = (hooks.select(F.col("node").alias(c), F.col("to").alias(f"{c}_end")) for c in ("u", "v"))
        renamed = salted_join(salted_join(left, at_u, "u"), at_v, "v").select(F.col("u_end").alias("u"), F.col("v_end").alias("v"))
        left = cut(renamed.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
