"""Packing token sequences: Martello-Toth dominance reduction, then best fit.

Lengths are integers up to the capacity, so an instance of any size is a histogram of
at most `capacity` counts. The plan (which lengths share a sequence, and how often) is
made from that histogram and its size doesn't depend on the number of documents;
documents then find their place by their rank among those of equal length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

CAPACITY, END = 1024, 2
VOCABULARY = "byte_bpe_50k"

_ENCODERS: dict = {}


def encoder(vocabulary: str = VOCABULARY):
    """The tokenizer of this process: ids of the vocabulary's tokenizers file, made from its rank file, which is four times as fast.

    The file's added tokens are one id each wherever their strings stand in a text.
    """
    if vocabulary not in _ENCODERS:
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        _ENCODERS[vocabulary] = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _ENCODERS[vocabulary]


def token_ids(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The ids of a whole text, without the end id."""
    try:
        return encoder(vocabulary).encode_to_numpy(text, allowed_special="all")
    except ValueError:  # the rank file's pattern runs out of stack on some hundred thousand blanks in a row
        import public_tokenizers
        from tokenizers import Tokenizer

        if (vocabulary, "whole") not in _ENCODERS:
            _ENCODERS[vocabulary, "whole"] = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        return np.array(_ENCODERS[vocabulary, "whole"].encode(text, add_special_tokens=False).ids)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first have the full capacity."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, part, nth): nth counts the pieces of equal length within the part."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def split(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows: list[tuple] = []
            at: list[int] = []
            for i, text in enumerate(batch.column("text")):
                ids = np.append(token_ids(text.as_py() or "", vocabulary), END).astype("<u4")
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    rows.append((piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, seen[length]))
                    at.append(i)
                    seen[length] += 1
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            cols = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *cols], names=[id_col, "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        split, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long, part int, nth long"
    )


def _reduce(count: np.ndarray, capacity: int, fix) -> None:
    """Martello-Toth reduction: fix sets that dominate every other set holding their largest item j.

    A set dominates another if the other's items can be dealt into groups that fit
    within its items. With j and its largest partner k these sets are fixed:
    - {j}, if nothing fits beside j;
    - {j, k}, if it is full, if no two items fit beside j, or if no two that fit add up to more than k;
    - {j, a, b}, if no three items fit beside j, a is the largest partner, b the largest that
      fits beside both, and no two items above b fit beside j.
    Equal items are fixed as often as the rule holds for them.
    """
    for j in range(capacity, 0, -1):
        while count[j]:
            room = capacity - j
            count[j] -= 1  # j itself is no partner
            sizes = np.flatnonzero(count)
            count[j] += 1
            sizes = sizes[sizes > 0]
            partners = sizes[sizes <= room]
            if not len(partners):
                fix([(j, 1)], int(count[j]) if j > room else 1)
                continue
            k = int(partners[-1])
            small = np.repeat(partners, np.minimum(count[partners], 3))[:3] if len(partners) else partners
            pair = k + j == capacity or len(small) < 2 or small[0] + small[1] > room
            best = 0
            if not pair:
                # the greatest sum of two items that fit beside j
                hi = len(partners) - 1
                for lo in range(len(partners)):
                    while hi >= lo and partners[lo] + partners[hi] > room:
                        hi -= 1
                    if hi < lo:
                        break
                    if hi > lo or count[partners[lo]] - (partners[lo] == j) >= 2:
                        best = max(best, int(partners[lo] + partners[hi]))
                    elif lo > 0:
                        best = max(best, int(partners[lo] + partners[lo - 1]))
                pair = best <= k
            if pair:
                n = int(min(count[j], count[k])) if k != j else int(count[j]) // 2
                fix([(j, 1), (k, 1)] if k != j else [(j, 2)], max(1, n))
                continue
            if len(small) < 3 or small[0] + small[1] + small[2] > room:
                own = lambda s: count[s] - (s == j) - (s == k)
                beside = [int(s) for s in partners[partners <= room - k] if own(s) > 0]
                if beside:
                    b = beside[-1]
                    above = partners[partners > b]
                    if not len(above) or 2 * int(above[0]) > room:
                        parts = Counter([j, k, b])
                        n = min(int(count[s]) // q for s, q in parts.items())
                        fix(sorted(parts.items(), reverse=True), max(1, n))
                        continue
            break


def _best_fit(count: np.ndarray, capacity: int) -> Counter:
    """Best-fit decreasing over a histogram; patterns ((size, times), ...) with how often each is used."""
    open_bins: dict[int, Counter] = {}
    done: Counter = Counter()

    def put(room: int, pattern: tuple, n: int) -> None:
        if n:
            open_bins.setdefault(room, Counter())[pattern] += n

    for s in range(capacity, 0, -1):
        left = int(count[s])
        while left:
            room = min((r for r in open_bins if r >= s), default=None)
            if room is None:
                each = capacity // s
                put(capacity - each * s, ((s, each),), left // each)
                if rest := left % each:
                    put(capacity - rest * s, ((s, rest),), 1)
                left = 0
                continue
            pattern, n = next(iter(open_bins[room].items()))
            each = room // s
            take = min(n, left // each)
            if take:
                put(room - each * s, (*pattern, (s, each)), take)
                left -= take * each
            elif left:  # fewer than one bin takes
                put(room - left * s, (*pattern, (s, left)), 1)
                take, left = 1, 0
            if n == take:
                del open_bins[room][pattern]
                if not open_bins[room]:
                    del open_bins[room]
            else:
                open_bins[room][pattern] = n - take
    for patterns in open_bins.values():
        done.update(patterns)
    return done


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Patterns ((size, times), ...) and how many sequences follow each; sizes are 1 to capacity."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for s, n in histogram.items():
        count[s] += n
    patterns: Counter = Counter()

    def fix(pattern, n):
        for s, q in pattern:
            count[s] -= q * n
        patterns[tuple(pattern)] += n

    _reduce(count, capacity, fix)
    patterns.update(_best_fit(count, capacity))
    return patterns


def slots(patterns: Counter) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, first sequence, times in it, offset): the piece of that length with rank r, low <= r < high, goes to
    sequence first + (r - low) // times at offset + (r - low) % times * length."""
    out, used, sequence = [], Counter(), 0
    for pattern, n in sorted(patterns.items()):
        offset = 0
        for s, q in pattern:
            out.append((s, used[s], used[s] + n * q, sequence, q, offset))
            used[s] += n * q
            offset += s * q
        sequence += n
    return out


def _by_length(table) -> dict[int, tuple]:
    """The slots of each length as arrays (low, first sequence, times, offset) in the order of their ranks."""
    own: dict[int, list] = {}
    for s, low, _, first, times, offset in table:
        own.setdefault(s, []).append((low, first, times, offset))
    return {s: tuple(np.array(sorted(rows), dtype=np.int64).T) for s, rows in own.items()}


def pack(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pack every document into sequences of at most `capacity` tokens.

    A document is its token ids and then the end id; a null or empty text is the end id
    alone. Only a document longer than the capacity is cut, into pieces of the capacity,
    the first of which may be shorter. The string of an added token of the vocabulary is
    that token's id. Repeated rows and null ids are packed each; an empty table gives no rows.

    Returns (id_col, piece, start, length, ids_crc32, sequence_id, offset).
    """
    spark = docs.sparkSession
    made = cut(pieces(docs, text_col, id_col, capacity, vocabulary))
    counts = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # at most a few segments for each of `capacity` lengths, whatever the number of documents
    shared = spark.sparkContext.broadcast(_by_length(slots(plan(histogram, capacity))))
    id_type = docs.schema[id_col].dataType.simpleString()

    def place(batches):
        segments = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros((2, len(rank)), dtype=np.int64)
            for n in np.unique(length):
                own = length == n
                low, first, times, base = segments[int(n)]
                i = np.searchsorted(low, rank[own], side="right") - 1
                turn = rank[own] - low[i]
                sequence[own], offset[own] = first[i] + turn // times[i], base[i] + turn % times[i] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(starts.select("part", "length", "before"), ["part", "length"])
    return ranked.select(F.col(id_col).alias("id"), "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")).mapInArrow(
        place, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
