"""Near-duplicate join on word n-grams by MinHash banding.

1. Every text is reduced to its set of shingles; texts with equal sets are one class.
2. Classes meet in buckets of equal bands; a bucket ties its classes to its least one,
   so the ties are linear in the bucket's size, and tied classes form candidate groups.
3. Each candidate group is verified on full shingle sets, in blocks of bounded size:
   every pair of classes in a group, but those whose sizes alone rule similarity out, is
   compared by set intersection within some task, and a task returns counts of links and
   a spanning forest, never the pairs.
4. Verified ties form the classes of near duplicates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, mix64, rows_with_keys, salted_join, shuffle_width, slices
from .topk import _group_rows
from .words import SHINGLE, SIMILAR, Shingler

#: Rows of a band, and the chance that a pair at the threshold shares a band at least.
ROWS, RECALL = 5, 0.9999

#: Classes in a verification block, and bytes of their shingle sets, about: a task holds two blocks at a time.
BLOCK, BLOCK_BYTES = 256, 8_000_000


def bands_for(threshold: float = SIMILAR, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands of so many rows that reach the recall at the threshold: 1 - (1 - s^r)^b."""
    hit = threshold**rows
    return 1 if hit >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def _size_step(threshold: float) -> float:
    """The ratio that spans a band of set sizes: similar sets lie in one band or in neighbouring ones, a hair of slack included."""
    return (1 / threshold if threshold < 1 else 2.0) * (1 + 1e-9)


class Signer:
    """MinHash bands of a shingle set."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20_240_501)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)

    def bands_of(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.bands * self.rows, 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(x), 1024):
            part = x[i : i + 1024, None] * self.a + self.b
            part ^= part >> np.uint32(15)
            np.minimum(low, part.min(axis=0), out=low)
        out = np.arange(self.bands, dtype=np.uint64)
        for column in low.reshape(self.bands, self.rows).T:
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
        return out.view(np.int64)


def signatures(docs: DataFrame, text_col: str, id_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, tkey, node, size, bands): tkey is the text's md5, node the digest of its shingle set (null without words) and size that set's."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def sign(batches):
        shingler, signer = Shingler(shingle), Signer(bands, rows)
        for batch in slices(batches):
            nodes, sizes, signed = [], [], []
            for text in batch.column("text"):
                s = shingler.shingles(text.as_py())
                sizes.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signed.append(signer.bands_of(s).tolist() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("tkey"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signed, pa.list_(pa.int64()))],
                names=["id", "tkey", "node", "size", "bands"],
            )

    rows_in = docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.md5(F.col(f"`{text_col}`").cast("binary"))).alias("tkey"), F.col(f"`{text_col}`").alias("text"))
    return rows_in.mapInArrow(sign, f"id {id_type}, tkey binary, node binary, size long, bands array<long>")


def _intersections(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of sets[:left] with all sets: a product of membership matrices over the shingles that two sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.append(True, values[1:] != values[:-1])
    column = np.cumsum(first) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    out = np.zeros((left, len(sets)), dtype=np.float64)
    width = max(1, 2_000_000 // max(1, len(sets)))
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (low, low + width))
        m = np.zeros((len(sets), width if b < len(column) else int(column[b - 1]) - low + 1), dtype=np.float32)
        m[owner[a:b], column[a:b] - low] = 1
        out += m[:left] @ m.T
    return out


def _forest(adjacent: np.ndarray) -> np.ndarray:
    """The least row that each row can reach."""
    n = len(adjacent)
    label = np.arange(n)
    for start in range(n):
        if label[start] != start or not adjacent[start].any():
            continue
        front = np.array([start])
        while len(front):
            near = np.flatnonzero(adjacent[front].any(axis=0) & (label > start))
            label[near] = start
            front = near
    return label


def _verify(batches, threshold):
    for (_, low, high), table in _group_rows(batches, ["comp", "low", "high"]):
        cols = table.to_pydict()
        order = sorted(range(table.num_rows), key=lambda i: (cols["blk"][i] != low, cols["node"][i]))
        sets = [np.frombuffer(cols["shingles"][i], dtype=np.uint64) for i in order]
        nodes, docs = [cols["node"][i] for i in order], np.array([cols["n_docs"][i] for i in order], dtype=np.int64)
        left = sum(cols["blk"][i] == low for i in order)
        if not left or (low != high and left == len(order)) or len(order) < 2:
            continue
        sizes = np.array([len(s) for s in sets], dtype=np.float64)
        both = _intersections(sets, left)
        # |a & b| / |a | b| >= t, compared without dividing; a hair of slack for the product's rounding
        near = both >= threshold * (sizes[:left, None] + sizes[None, :] - both) - 1e-9
        whole = np.zeros((len(order), len(order)), dtype=bool)
        if low == high:
            whole[:] = near
            np.fill_diagonal(whole, False)
        else:
            whole[:left, left:] = near[:, left:]
            whole[left:, :left] = near[:, left:].T
        links, classes = whole @ docs, whole.sum(axis=1)
        root = _forest(whole)
        hit = np.flatnonzero(classes)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([nodes[i] for i in hit], pa.binary()),
                pa.array([nodes[root[i]] for i in hit], pa.binary()),
                pa.array(links[hit], pa.int64()),
                pa.array(classes[hit].astype(np.int64), pa.int64()),
            ],
            names=["u", "v", "links", "classes"],
        )


def _classes(docs: DataFrame, text_col: str, id_col: str, threshold: float, shingle: int, recall: float, rows: int) -> DataFrame:
    """near_duplicates with plain names, and with `head`: no_id, id and tkey of the class's first document."""
    spark = docs.sparkSession
    bands = bands_for(threshold, recall, rows)
    signed = cut(signatures(docs, text_col, id_col, shingle, bands, rows))
    nodes = cut(
        signed.filter(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.count("*").alias("n_docs"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "tkey")).alias("head"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    )
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = placed.groupBy("bucket").agg(F.min("node").alias("v"), F.max("node").alias("w")).filter("v < w").select("bucket", "v")
    ties = placed.join(buckets, "bucket").filter(F.col("node") != F.col("v")).select(F.col("node").alias("u"), "v").distinct()
    comps = connected_components(ties).join(nodes.select("node", F.col("head.tkey").alias("tkey"), "n_docs", "size"), "node")
    # as many blocks as keep to both bounds on average; classes are dealt to them by hash, and in groups of several blocks by
    # bands of set sizes first: sizes whose bands are no neighbours differ by more than similar sets can
    band = F.floor(F.log(F.col("size")) / math.log(_size_step(threshold))).cast("long")
    comps = comps.withColumn("band", band)
    wanted = lambda n, size: F.ceil(F.greatest(n / BLOCK, size * 8 / BLOCK_BYTES)).cast("long")
    by_band = comps.groupBy("label", "band").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    by_group = by_band.groupBy("label").agg(
        wanted(F.sum("n"), F.sum("s")).alias("all"), F.map_from_entries(F.collect_list(F.struct("band", wanted(F.col("n"), F.col("s"))))).alias("blocks")
    )
    blocks = lambda step: F.coalesce(F.try_element_at("blocks", F.col("band") + step), F.lit(0))
    one = F.col("all") <= 1
    dealt_to = [F.when(one, 0).otherwise(blocks(-1)).alias("below"), F.when(one, 1).otherwise(blocks(0)).alias("own"), F.when(one, 0).otherwise(blocks(1)).alias("above")]
    cand = cut(salted_join(comps, by_group, "label").select("node", "tkey", "n_docs", F.col("label").alias("comp"), F.when(one, 0).otherwise(F.col("band")).alias("band"), *dealt_to))
    places = ("comp", "band", "below", "own", "above")

    def gather(batches):
        shingler = Shingler(shingle)
        for batch in slices(batches):
            sets = [shingler.shingles(x.as_py()).tobytes() for x in batch.column("text")]
            cols = [batch.column(c) for c in ("node", "n_docs", *places)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sets, pa.binary())], names=["node", "n_docs", *places, "shingles"])

    # a class has one text of its own: only those of candidates are shuffled
    text = F.col(f"`{text_col}`")
    held = rows_with_keys(docs.select(text.alias("text")).filter("text is not null"), F.unhex(F.md5(F.col("text").cast("binary"))), cand.select("tkey"))
    held = (
        held.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("tkey"), "text")
        .dropDuplicates(["tkey"])
        .join(cand, "tkey")
        .select("node", "n_docs", *places, "text")
        .mapInArrow(gather, "node binary, n_docs long, comp binary, band long, below long, own long, above long, shingles binary")
    )
    place = lambda band, i: band * F.lit(2**32) + i  # noqa: E731  a block is numbered by its band and its place there

    def met_in(step: int, n: str):
        # the step is bound here: a second parameter of the lambda would be the element's index
        each = F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), lambda i: place(F.col("band") + step, i))
        return F.when(F.col(n) > 0, each).otherwise(F.array().cast("array<long>"))

    met = [met_in(-1, "below"), met_in(0, "own"), met_in(1, "above")]
    dealt = (
        held.withColumn("blk", place(F.col("band"), F.pmod(F.xxhash64("node"), F.col("own"))))
        .withColumn("other", F.explode(F.concat(*met)))
        .select("comp", F.least("blk", "other").alias("low"), F.greatest("blk", "other").alias("high"), "blk", "node", "n_docs", "shingles")
    )
    checked = cut(
        dealt.repartition(shuffle_width(spark), "comp", "low", "high")
        .sortWithinPartitions("comp", "low", "high")
        .mapInArrow(lambda it: _verify(it, threshold), "u binary, v binary, links long, classes long")
    )
    links = checked.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"), F.sum("classes").alias("classes"))
    groups = connected_components(checked.filter(F.col("u") != F.col("v")).select("u", "v"))
    plain = nodes.select("node", "head", "n_docs").join(links, "node", "left")
    # classes of one node name themselves; the members of the others are joined to their class by parts
    tied = cut(plain.join(groups, "node"))
    named = tied.groupBy("label").agg(F.min("head").alias("head"), F.sum("n_docs").alias("class_size"))
    own = [(F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"), F.coalesce("classes", F.lit(0)).alias("n_texts")]
    of_group = salted_join(tied.withColumnRenamed("head", "own_head"), named, "label").select("node", F.col("label").alias("class_key"), "head", "class_size", *own)
    alone = plain.join(groups.select("node"), "node", "left_anti").select("node", F.col("node").alias("class_key"), "head", F.col("n_docs").alias("class_size"), *own)
    return signed.select("id", "tkey", "node").join(of_group.unionByName(alone), "node", "left")


def near_duplicates(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    threshold: float = SIMILAR,
    shingle: int = SHINGLE,
    recall: float = RECALL,
    rows: int = ROWS,
) -> DataFrame:
    """Group documents whose shingle sets have Jaccard similarity of `threshold` or more, and count their links.

    Words are runs of letters, digits and underscores, lower-cased; a text of fewer
    words than a shingle is one shingle. Texts with equal shingle sets are one class
    (similarity 1). A null text, or one without words, is similar to nothing and stays
    alone. Repeated rows and rows that share an id are documents of their own; a class
    is named by the least id in it (null if it has none).

    Returns one row per document: (id_col, tkey, class_key, class_id, class_size, n_links,
    n_texts): key, name and size of the group of near duplicates (key null without
    words), n_links the other documents, n_texts the other shingle sets, that are
    similar to this one.
    """
    return _classes(docs, text_col, id_col, threshold, shingle, recall, rows).select(
        F.col("id").alias(id_col),
        "tkey",
        "class_key",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
    )


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = SIMILAR, shingle: int = SHINGLE, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """The documents without near duplicates of a smaller id: of each class, the row of its least (id, text digest) stays.

    Documents without words all stay. Of rows that repeat both id and text, one stays if
    the text has words. The columns of docs are returned, whatever their names. What is
    dropped is looked up by key, so rows that stay aren't shuffled.
    """
    key_of = lambda i, t: F.unhex(F.md5(F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("~")), F.coalesce(F.hex(t), F.lit("~")))))
    found = _classes(docs, text_col, id_col, threshold, shingle, recall, rows).filter("node is not null")
    first = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("tkey") == F.col("head.tkey"))
    keys = cut(found.groupBy(key_of(F.col("id"), F.col("tkey")).alias("key")).agg(F.first(first).alias("stays"), F.count("*").alias("copies")))
    own = key_of(F.col(f"`{id_col}`"), F.unhex(F.md5(F.col(f"`{text_col}`").cast("binary"))))
    out = rows_with_keys(docs, own, cut(keys.filter("not stays or copies > 1").select("key")), keep=False)
    repeated = keys.filter("stays and copies > 1").select("key")
    if repeated.limit(1).count():
        out = out.unionByName(rows_with_keys(docs, own, repeated).dropDuplicates([id_col, text_col]))
    return out
