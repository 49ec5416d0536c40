"""Importance resampling of a corpus towards a target distribution, by hashed features.

1. Words of every text are hashed into buckets, and each task adds up its own counts; the
   corpus and the target become two arrays of one number a bucket.
2. A bucket's gain is the rounded log ratio of both; a task scores its documents against
   the array of gains: the floored mean of their gains, and a Gumbel draw from the id.
3. Scores are integers of a bounded range, so their exact histogram is small. Its counts,
   summed from the top, give every score the number of documents before it, and the
   cutoff; only documents at or above it are ranked, by id within each score.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, cut, slices

#: Buckets of features, words of a feature at most, words that a document needs to be drawn, percent drawn, and the draw's seed.
BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024

#: Bytes of a text that are cut into words at a time, about.
PIECE = 1 << 20

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Bytes of a text as word bytes or blanks, A-Z as a-z.
_BYTES = bytes(b if b in _WORD else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_in_pieces(text: str | None, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text as UTF-8, in lists of bounded size: runs of ASCII letters and digits and of all characters beyond ASCII."""
    if not text:
        return
    raw = text.encode("utf-8", "surrogatepass").translate(_BYTES)
    start = 0
    while start < len(raw):
        end = start + piece
        if end < len(raw):
            back = raw.rfind(b" ", start, end)
            end = back + 1 if back >= 0 else raw.find(b" ", end) + 1 or len(raw)
        yield raw[start:end].split()
        start = end


class Features:
    """Numbers of the buckets of a text's features: all runs of 1 to `run` words, each repeat counted."""

    def __init__(self, buckets: int = BUCKETS, run: int = RUN):
        self.run, self.bucket = run, Memo(lambda f: zlib.crc32(f) % buckets)

    def of(self, text: str | None) -> Iterator[tuple[int, np.ndarray]]:
        """(words, buckets of the runs that end in them) of one piece of the text after the other."""
        before: list[bytes] = []
        for found in words_in_pieces(text):
            held, n = before + found, len(before)
            runs = [found, *([b" ".join(held[i - k + 1 : i + 1]) for i in range(max(n, k - 1), len(held))] for k in range(2, self.run + 1))]
            numbers = [np.fromiter(map(self.bucket.__getitem__, r), dtype=np.int64) for r in runs]
            yield len(found), np.concatenate(numbers) if self.run > 1 else numbers[0]
            before = held[len(held) - self.run + 1 :] if self.run > 1 else []


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """How many features of all texts fall in each bucket: every task sends one row a bucket at most, and they are added up before the driver sees them."""

    def count(batches):
        features, total = Features(buckets, run), np.zeros(buckets, dtype=np.int64)
        for batch in slices(batches):
            for text in batch.column(0):
                for _, numbers in features.of(text.as_py()):
                    total += np.bincount(numbers, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit], pa.int64())], names=["bucket", "n"])

    rows = docs.select(F.col(f"`{text_col}`").alias("text")).filter("text is not null").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets, in doubles."""
    b, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + b) / ((float(s) + 1) * (t_all + b)))) for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def gumbel(doc_id: str, seed: int = SEED) -> int:
    """floor(-1000 ln(-ln((h + 1/2) / 2^32))), h the first 32 bits of sha256 of seed and id."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, text_col: str, id_col: str, run: int, seed: int) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every document."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        features, gain = Features(buckets, run), shared.value
        for batch in slices(batches):
            words, counts, weights, scores = [], [], [], []
            for name, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                total = n = n_words = 0
                for found, numbers in features.of(text.as_py()):
                    total, n, n_words = total + int(gain[numbers].sum()), n + len(numbers), n_words + found
                words.append(n_words)
                counts.append(n)
                weights.append(total // n if n else 0)
                scores.append(weights[-1] + gumbel(name, seed))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, counts, weights, scores))], names=["id", "n_words", "n_features", "weight", "score"])

    own = F.col(f"`{id_col}`")
    rows = docs.select(own.alias("id"), F.coalesce(own.cast("string"), F.lit("")).alias("name"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(score, f"id {kind}, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    target_col: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    run: int = RUN,
    seed: int = SEED,
) -> DataFrame:
    """Draw `percent` of the documents of at least `least_words` words, those most like the target likelier, and rank them.

    Of the N documents that are long enough, floor(percent N / 100) of the highest scores
    are drawn, ties to the smaller id, a null one last; rows that repeat an id are drawn
    each (in any order where their scores are equal too). A null or empty text has no
    features, weight 0 and is never drawn unless least_words is 0; a null id draws as an
    empty one. Without target texts all gains come from the corpus alone. Other columns,
    of whatever name, are not looked at.

    Returns (id_col, n_features, weight, score, rank) of every document; rank counts from
    1 and is null for those not drawn.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, run), bucket_counts(target, target_col, buckets, run))
    rows = cut(scored(docs, gain, text_col, id_col, run, seed))
    long_enough = F.col("n_words") >= least_words
    # a row for each score: at most the spread of gains and draws, whatever the number of documents
    held = rows.filter(long_enough).groupBy("score").agg(F.count("*").alias("n")).toArrow()
    order = np.argsort(-held.column("score").to_numpy(), kind="stable")
    score, n = held.column("score").to_numpy()[order], held.column("n").to_numpy()[order]
    above = np.cumsum(n) - n
    drawn = int(n.sum()) * percent // 100
    survive = above < drawn
    out = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not survive.any():
        return rows.select(*out, none)
    offsets = docs.sparkSession.createDataFrame(pa.table({"score": score[survive], "above": above[survive].astype(np.int64)}))
    cutoff = int(score[survive][-1])
    stays = long_enough & (F.col("score") >= cutoff)
    within = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last())
    ranked = rows.filter(stays).join(F.broadcast(offsets), "score").withColumn("rank", F.col("above") + F.row_number().over(within))
    ranked = ranked.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
    return rows.filter(~stays).select(*out, none).unionByName(ranked)
