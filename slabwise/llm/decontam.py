"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

The CGK walk turns word edit distance into Hamming distance: it reads a string of
words, at step j writes the word it stands on and moves on or stays by a random bit of
(j, word). Two strings that differ by a few edits soon walk in step again, so they
agree at most of the written places. A hash function samples some of those places.

A window of an item's size is embedded from an anchor within it to the item's farther
end, and sampled over that whole way: at all places at which the walk can't have left the
item (the way's length is rounded down to one of a few, at most a fifth shorter).
Anchors are the item's rarest words, several to an item, and every hash function
samples the walk's first place, which is the anchor itself; so a document's window is
dismissed, exactly, as soon as it doesn't stand on an anchor word, or differs from all
items at the places sampled so far, and walked on only for the rest. Functions are added until edited copies of the items
themselves are found at the target recall. Items too short for a walk, and all where
functions don't get there, are cut into one stretch more than edits are allowed, one of
which every near copy holds unchanged.
Windows that collide with an item are verified by the edit distance of the whole item
to the document around the anchor.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, cut, filter_rows, mix64, texts
from .words import words

#: Words that may be inserted, deleted or replaced, as a share of the item's words.
EDITS = 0.2

#: Places of the walk that a hash function samples besides the first, anchors of an item, and the share of leaks to find.
SAMPLED, ANCHORS, RECALL = 2, 6, 0.999

#: Words from which an item is walked, and the bits of a function's walk: step and word choose one.
SHORT, POOL = 10, 1 << 18

#: Edited copies on which recall is measured, and the most hash functions; where these don't reach it, exact stretches are added.
TRIALS, FUNCTIONS = 1000, 64

#: Items that are searched for in one pass over the documents.
ITEMS_PER_PASS = 20_000


def _rounded(steps: int) -> int:
    """The greatest of 1, 2, ..., 9 and then lengths a fifth apart that is not above steps."""
    out = min(steps, 9)
    while (longer := out + max(1, out // 4)) <= steps and steps > 9:
        out = longer
    return out


class Index:
    """The items' anchors and stretches, in the order of their hash functions."""

    def __init__(self, items: list[tuple[object, str]], edits: float = EDITS, recall: float = RECALL, sampled: int = SAMPLED, seed: int = 5, functions: int = FUNCTIONS):
        self.edits, self.sampled, self.seed = edits, sampled, seed
        texts = [(i, words(t)) for i, t in items]
        texts = [(i, w) for i, w in texts if w]
        self.ids = [i for i, _ in texts]
        vocabulary = sorted({x for _, w in texts for x in w})
        self.code = {x: k + 1 for k, x in enumerate(vocabulary)}  # 0: any word of no item
        self.items = [np.array([self.code[x] for x in w], dtype=np.int32) for _, w in texts]
        self.limit = [min(int(edits * len(w)), len(w) - 1) for w in self.items]
        self.bags = [frozenset(w.tolist()) for w in self.items]
        self.n_codes = len(vocabulary) + 1
        common = Counter(c for w in self.items for c in w.tolist())
        places = []  # (item, offset) of anchors and stretches
        #: (direction, farthest step) -> [(number, place among the items' words)], and length -> [(number, item, offset)]
        self.anchors: dict[tuple[int, int], list[tuple[int, int]]] = {}
        stretches: dict[int, list[tuple[int, int, int]]] = {}

        def cut_up(k: int) -> None:
            n = len(self.items[k])
            ends = np.linspace(0, n, self.limit[k] + 2).round().astype(int).tolist()
            for a, b in zip(ends, ends[1:]):
                stretches.setdefault(b - a, []).append((len(places), k, a))
                places.append((k, a))

        begin = np.cumsum([0, *map(len, self.items)])
        for k, w in enumerate(self.items):
            n = len(w)
            if n < SHORT:
                cut_up(k)
                continue
            order = sorted(range(n), key=lambda p: (common[int(w[p])], -len(vocabulary[int(w[p]) - 1]), p))
            # an anchor for each stretch of the item first, then the rarest of the rest
            stretch = max(1, math.ceil(n / ANCHORS))
            chosen, used = [], set()
            for p in order:
                if p // stretch not in used:
                    used.add(p // stretch)
                    chosen.append(p)
            chosen += [p for p in order if p not in chosen]
            for p in chosen[:ANCHORS]:
                d = 1 if p < n / 2 else -1
                steps = _rounded((n - p if d > 0 else p + 1) - 1)  # a step moves on by a word at most
                self.anchors.setdefault((d, steps), []).append((len(places), int(begin[k]) + p))
                places.append((k, p))
        self.places = np.array(places, dtype=np.int64).reshape(-1, 2)
        self.all_words = np.concatenate([np.zeros(0, np.int32), *self.items])
        self.is_anchor = {c: self._mask(self.all_words[[p for _, p in own]]) for c, own in sorted(self.anchors.items())}
        self.any_anchor = np.logical_or.reduce([np.zeros(self.n_codes, dtype=bool), *self.is_anchor.values()])
        self.stretches: dict = {}
        self.functions: list[dict] = []  # of each: the bits, and by class the sampled places, the sorted keys and the table
        self._grow_to(recall, functions)
        if self.measured < recall:
            # hash functions alone don't get there: walked items are cut into stretches too, which is exact
            for k, w in enumerate(self.items):
                if len(w) >= SHORT:
                    cut_up(k)
            self.places = np.array(places, dtype=np.int64).reshape(-1, 2)
        for length, own in stretches.items():
            table: dict[int, list[int]] = {}
            for number, k, a in own:
                table.setdefault(int(self._runs(self.items[k], np.array([a]), length)[0]), []).append(number)
            self.stretches[length] = (self._mask([self.items[k][a] for _, k, a in own]), np.array(sorted(table), dtype=np.int64), table)

    def _mask(self, codes) -> np.ndarray:
        out = np.zeros(self.n_codes, dtype=bool)
        out[np.asarray(codes, dtype=np.int64)] = True
        return out

    @staticmethod
    def _runs(codes: np.ndarray, where: np.ndarray, length: int) -> np.ndarray:
        """The hash of `length` words from each place."""
        key = np.zeros(len(where), dtype=np.int64)
        for i in range(length):
            key = key * 1_000_003 + codes[where + i]
        return key

    def _add_function(self) -> None:
        r = len(self.functions)
        rng = np.random.default_rng((self.seed, r))
        longest = max((steps for _, steps in self.anchors), default=0)
        bits = mix64(np.arange(POOL, dtype=np.uint64) + np.uint64((self.seed * FUNCTIONS + r) << 36)) >> np.uint64(63)
        function = {"bits": (bits.astype(np.int8), rng.integers(0, POOL, longest + 1)), "classes": {}}
        for c, own in sorted(self.anchors.items()):
            sampled = np.sort(rng.choice(np.arange(1, c[1] + 1), min(self.sampled, c[1]), replace=False))
            where = np.array([p for _, p in own])
            known = [np.unique(self.walk(self.all_words, where, c[0], function["bits"], sampled[: i + 1])[1]) for i in range(len(sampled) - 1)]
            keys = self.walk(self.all_words, where, c[0], function["bits"], sampled)[1]
            table: dict[int, list[int]] = {}
            for (number, _), key in zip(own, keys.tolist()):
                table.setdefault(key, []).append(number)
            function["classes"][c] = (sampled, [*known, np.array(sorted(table), dtype=np.int64)], table)
        self.functions.append(function)

    def _grow_to(self, recall: float, most: int) -> None:
        """Add functions until edited copies of walked items, at the limit of their edits, collide with them at the recall; `measured` is what they reach."""
        self.measured = 1.0
        long = [k for k, w in enumerate(self.items) if len(w) >= SHORT]
        if not long:
            return
        rng = np.random.default_rng(self.seed)
        trials, wanted = [], []
        for i in range(TRIALS):
            k = long[i % len(long)] if len(long) <= TRIALS else int(rng.choice(long))
            trials.append(self._edited(k, rng))
            wanted.append(k)
        missed = np.arange(TRIALS)
        while len(missed) > (1 - recall) * TRIALS and len(self.functions) < most:
            self._add_function()
            found = self.candidates([trials[i] for i in missed], self.functions[-1:])
            hit = {(t, k) for t, k, _ in found.tolist()}
            missed = np.array([i for t, i in enumerate(missed.tolist()) if (t, wanted[i]) not in hit], dtype=np.int64)
        self.measured = 1 - len(missed) / TRIALS

    def _edited(self, k: int, rng) -> np.ndarray:
        """A copy of an item with as many edits as allowed, between other words."""
        word = lambda n: rng.integers(0, self.n_codes, n).tolist()
        w = self.items[k].tolist()
        for _ in range(self.limit[k]):
            kind, p = rng.integers(3), int(rng.integers(len(w)))
            w[p : p + (kind > 0)] = word(1) if kind < 2 else []
        return np.array([*word(15), *w, *word(15)], dtype=np.int32)

    @staticmethod
    def walk(codes: np.ndarray, where: np.ndarray, direction: int, bits: tuple, sampled: np.ndarray, known: list | None = None, bounds: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(number among where, hash) of the walk from each place: the anchor and what is written at the sampled steps.

        known: for each sampled step the sorted hashes up to it; places with another one are left out from there on.
        bounds: first and last place of each walk, which it doesn't pass.
        """
        pool, offset = bits
        at, key, left = where.copy(), codes[where].astype(np.int64), np.arange(len(where))
        low, high = bounds if bounds is not None else (np.zeros(len(where), np.int64), np.full(len(where), len(codes) - 1))
        written = {int(j): i for i, j in enumerate(sampled)}
        for j in range(int(sampled[-1]) + 1 if len(sampled) else 0):
            here = codes[at]
            if j in written:
                key = key * 1_000_003 + here
                if known is not None:
                    of = known[written[j]]
                    keep = np.flatnonzero(of[np.minimum(np.searchsorted(of, key), len(of) - 1)] == key)
                    at, key, left, here, low, high = at[keep], key[keep], left[keep], here[keep], low[keep], high[keep]
                if not len(left):
                    break
            at = np.clip(at + direction * pool[(here.astype(np.int64) * 0x9E37 + offset[j]) & (POOL - 1)], low, high)
        return left, key

    def candidates(self, texts: list[np.ndarray], functions: list[dict] | None = None) -> np.ndarray:
        """Distinct rows (text, item, start) wherever a window of a text collides with an item; start is where the item would begin."""
        gap = np.zeros(1, np.int32)  # a word of no item on both sides of a text, at which walks stay
        codes = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
        begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
        found = []

        def collide(where, keys, table, numbers):
            if not len(table):
                return
            i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
            for h in np.flatnonzero(table[i] == keys).tolist():
                for number in numbers[int(keys[h])]:
                    found.append((int(where[h]), number))

        every = np.flatnonzero(self.any_anchor[codes])
        text_of = np.searchsorted(begin, every, side="right") - 1
        first, last, at_anchor = begin[text_of] - 1, begin[text_of + 1] - 1, codes[every]
        for c, mask in self.is_anchor.items():
            own = np.flatnonzero(mask[at_anchor])
            for f in (self.functions if functions is None else functions) if len(own) else ():
                sampled, known, numbers = f["classes"][c]
                left, keys = self.walk(codes, every[own], c[0], f["bits"], sampled, known, (first[own], last[own]))
                collide(every[own][left], keys, known[-1], numbers)
        for length, (mask, table, numbers) in self.stretches.items():
            where = np.flatnonzero(mask[codes[: len(codes) - length]])
            collide(where, self._runs(codes, where, length), table, numbers)
        if not found:
            return np.zeros((0, 3), dtype=np.int64)
        place, number = np.unique(np.array(found, dtype=np.int64), axis=0).T
        text = np.searchsorted(begin, place, side="right") - 1
        item, offset = self.places[number].T
        return np.unique(np.column_stack([text, item, place - begin[text] - offset]), axis=0)

    def matches(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(text, item, least edit distance, first word of its window) for items that a text holds within their limit."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        last, held, verified = None, [], None
        for text, k, start in self.candidates(texts).tolist():
            item, limit = self.items[k], self.limit[k]
            if (text, k) != last:
                last, verified = (text, k), None
            if not held or held[0] != text:
                held = [text, texts[text].tolist()]
            if verified is not None and start - verified <= limit:
                continue  # the stretch around the start before was verified, with slack for both
            if best.get((text, k), (1, 0))[0] == 0:
                continue  # nothing is nearer than an exact copy
            low, high = max(0, start - limit), max(0, start + len(item) + 3 * limit)
            # an edit takes away one of the item's distinct words at most
            if len(self.bags[k].intersection(held[1][low:high])) < len(self.bags[k]) - limit:
                continue
            verified = start
            found = nearest(item, texts[text][low:high])
            if found and found[0] <= limit:
                best[text, k] = min(best.get((text, k), (limit + 1, 0)), (found[0], low + found[1]))
        return [(t, k, *v) for (t, k), v in sorted(best.items())]

    def coder(self) -> Memo:
        code = self.code.get
        return Memo(lambda w: code(w, 0))

    def search(self, texts, coded: Memo):
        """`matches` of texts, a bounded number of words at a time; the text's place among texts comes first."""
        codes, at, held = [], [], 0
        for i, text in enumerate(texts):
            w = words(text)
            if w:
                codes.append(np.fromiter(map(coded.__getitem__, w), dtype=np.int32, count=len(w)))
                at.append(i)
                held += len(w)
            if held >= 1_000_000:
                yield from ((at[t], *rest) for t, *rest in self.matches(codes))
                codes, at, held = [], [], 0
        if codes:
            yield from ((at[t], *rest) for t, *rest in self.matches(codes))


def nearest(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int] | None:
    """(edit distance, start) of the substring of the stretch nearest to the whole item."""
    n = len(stretch)
    if not n:
        return None
    places = np.arange(n + 1)
    row, start = np.zeros(n + 1, dtype=np.int64), places.copy()
    for i, x in enumerate(item, 1):
        change = row[:-1] + (stretch != x)
        drop = row[1:] + 1
        new = np.concatenate([[i], np.minimum(change, drop)])
        begin = np.concatenate([[0], np.where(change <= drop, start[:-1], start[1:])])
        # insertions run along the row: the least of new[p] + (place - p)
        shifted = new - places
        low = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == low, places, 0))
        row, start = low + places, begin[source]
    k = int(row.argmin())
    return int(row[k]), int(start[k])


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    item_col: str = "item_id",
    item_text_col: str = "text",
    edits: float = EDITS,
    recall: float = RECALL,
) -> DataFrame:
    """Documents that hold a benchmark item up to `edits` of its words inserted, deleted or replaced.

    Words are runs of letters, digits and underscores, lower-cased. Null or wordless
    items match nothing, nor do null or wordless texts. Repeated documents and items are
    reported each; null ids are kept. The benchmark is searched for in passes of
    ITEMS_PER_PASS items, so what a task holds doesn't grow with it.

    Returns (id_col, item_col, edit_distance, first_word): one row for each item that
    a document row holds, at its nearest window.
    """
    spark = docs.sparkSession
    items = _items(benchmark, item_col, item_text_col)
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema["item"].dataType
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"`{id_col}` {id_type}, `{item_col}` {item_type.simpleString()}, edit_distance int, first_word long"
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_item = to_arrow_type(item_type)
    out = None
    for index in _indexes(items, edits, recall):
        shared = spark.sparkContext.broadcast(index)

        def search(batches, shared=shared):
            index = shared.value
            coded = index.coder()
            for batch in batches:
                found = [(i, index.ids[item], distance, first) for i, item, distance, first in index.search(texts(batch.column("text")), coded)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array([f[0] for f in found], pa.int64())),
                        *(pa.array([f[j] for f in found], t) for j, t in ((1, arrow_item), (2, pa.int32()), (3, pa.int64()))),
                    ],
                    names=[id_col, item_col, "edit_distance", "first_word"],
                )

        one = rows.mapInArrow(search, schema)
        out = one if out is None else out.unionByName(one)
    return out


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    edits: float = EDITS,
    recall: float = RECALL,
) -> DataFrame:
    """The rows of docs whose text holds no benchmark item, whole and unshuffled; see find_leaks."""
    out = docs
    for index in _indexes(_items(benchmark, item_col, item_text_col), edits, recall):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def make_keep(shared=shared):
            index = shared.value
            coded = index.coder()

            def keep(texts):
                leaks = {i for i, *_ in index.search(texts, coded)}
                return [i not in leaks for i in range(len(texts))]

            return keep

        out = filter_rows(out, text_col, make_keep)
    return out


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return cut(benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text_col}`").alias("text")).filter("text is not null"))


def _indexes(items: DataFrame, edits: float, recall: float):
    """An index for each ITEMS_PER_PASS items or so, dealt by hash."""
    passes = max(1, math.ceil(items.count() / ITEMS_PER_PASS))
    for k in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k) if passes > 1 else items
        yield Index(sorted(((r["item"], r["text"]) for r in part.collect()), key=repr), edits, recall)
