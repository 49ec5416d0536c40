"""Toxic spans by a linear-chain conditional random field.

Labels mark documents; tokens are labelled from them: the words and word beginnings
that labelled texts tie to toxicity beyond chance mark the tokens of toxic texts. A
two-state CRF (clean, toxic) over each text's words is fitted to those tokens. Its
forward-backward marginals give the offending words and, through a logistic
calibration on the document labels, a score for the document.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, filter_rows, hashed_share, held_out, mix64, sigmoid, slices, texts
from .words import WORD, words

#: Bounds of the labelled sample: texts of either label, and characters of all of a label's texts together.
MOST_TOXIC, MOST_CLEAN, TOXIC_CHARS, CLEAN_CHARS = 1500, 3000, 5_000_000, 10_000_000

#: Words in a segment of the chain: texts are laid out, and fitted, in segments of this many words; what is before and after a
#: segment of a text is handed on when it is scored.
SEGMENT = 64

#: Segments whose chances are computed at a time.
BLOCK = 4096

#: A document is toxic from this score.
REJECT = 0.3


def features(word: str) -> tuple[str, ...]:
    """What the CRF sees of a lower-cased word: itself, its beginnings and its end."""
    return (f"w:{word}", *(f"p:{word[:n]}" for n in (4, 5, 6) if len(word) > n), f"s:{word[-3:]}")


class Model:
    """CRF weights: toxic minus clean score of each feature, the transitions [from, to], and the calibration."""

    def __init__(self, weights: dict[str, float], bias: float, transitions: np.ndarray, calibration: np.ndarray):
        self.bias, self.transitions, self.calibration = bias, transitions, calibration
        # by kind, so that a word's features are looked up without being spelled out; see features()
        self.whole, self.begin, self.end = ({f[2:]: x for f, x in weights.items() if f[0] == kind} for kind in "wps")

    def emission(self, word: str) -> float:
        out, n = self.bias + self.whole.get(word, 0.0) + self.end.get(word[-3:], 0.0), len(word)
        if n > 4:
            begin = self.begin.get
            out += begin(word[:4], 0.0)
            if n > 5:
                out += begin(word[:5], 0.0)
                if n > 6:
                    out += begin(word[:6], 0.0)
        return out


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, enter=None, leave=None, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Chance of the toxic state at each place of segments (rows, padded), and the expected number of each transition [from, to] if it is `counted`.

    Both messages are kept as odds, toxic to clean, which one step maps to odds between
    bounds that the transitions set, so nothing overflows. A segment within a text goes
    on from what was before it (`enter`, the odds that come to its first place) and to
    what comes after it (`leave`); without these it stands alone.
    """
    n, t = emissions.shape
    odds = np.exp(np.clip(emissions.T, -30, 30))
    (m00, m01), (m10, m11) = np.exp(transitions)
    inside = np.arange(t)[:, None] < lengths[None, :]
    leave = np.ones(n) if leave is None else leave
    forward = np.empty((t, n))
    state = forward[0] = odds[0] if enter is None else odds[0] * enter
    for i in range(1, t):
        state = forward[i] = odds[i] * (m01 + state * m11) / (m00 + state * m10)
    out, pairs = np.empty((t, n)), np.zeros((2, 2))
    back = leave  # of place i, from the places after it
    for i in range(t - 1, -1, -1):
        both = forward[i] * back
        out[i] = both / (1 + both)
        if i:
            after = odds[i] * back
            if counted:
                before, here = forward[i - 1], inside[i]
                joint = np.stack([np.full(n, m00), m01 * after, m10 * before, m11 * before * after])
                pairs += (joint[:, here] / joint[:, here].sum(axis=0)).sum(axis=1).reshape(2, 2)
            # beyond a segment's end nothing is known but what comes after it
            back = np.where(inside[i], (m10 + m11 * after) / (m00 + m01 * after), leave)
    out[~inside] = 0.0
    return out.T, pairs


def _passage(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """For each segment the 2 x 2 matrix, as four columns, that takes the weights of the states before it to those at its last place, up to a factor."""
    n, t = emissions.shape
    odds = np.exp(np.clip(emissions.T, -30, 30))
    (m00, m01), (m10, m11) = np.exp(transitions)
    whole = bool((lengths == t).all())
    p = [np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)]
    for i in range(t):
        a, b, c, d = p
        x = [a * m00 + b * m10, (a * m01 + b * m11) * odds[i], c * m00 + d * m10, (c * m01 + d * m11) * odds[i]]
        p = x if whole else [np.where(lengths > i, new, old) for new, old in zip(x, p)]
        if i % 8 == 7:
            total = p[0] + p[1] + p[2] + p[3]
            p = [x / total for x in p]
    return np.stack(p, axis=1)


def marginals(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Chance of the toxic state at each place of texts that are chains over consecutive segments: rows tells how many segments each text has.

    What a segment hands on is a product of 2 x 2 matrices; these are made for all
    segments at once, and only their products along a text are taken one by one.
    """
    n = len(emissions)
    parts = [slice(i, i + BLOCK) for i in range(0, n, BLOCK)]
    enter, leave = np.ones(n), np.ones(n)
    rows = rows[rows > 0]
    first = np.cumsum(rows) - rows
    if (rows > 1).any():
        (m00, m01), (m10, m11) = np.exp(transitions)
        passage = np.concatenate([_passage(emissions[p], lengths[p], transitions) for p in parts])
        # a text's first segment has no place before it: its own last state goes on
        start, left = first[rows > 1], rows[rows > 1]
        odds = np.exp(np.clip(emissions[start].T, -30, 30))
        state = odds[0]
        for i in range(1, len(odds)):
            state = odds[i] * (m01 + state * m11) / (m00 + state * m10)
        for step in range(1, int(rows.max())):
            on = left > step
            start, state, left = start[on], state[on], left[on]
            enter[start + step] = (m01 + state * m11) / (m00 + state * m10)
            a, b, c, d = passage[start + step].T
            state = (b + state * d) / (a + state * c)
        last, left = (first + rows - 1)[rows > 1], rows[rows > 1]
        back = np.ones(len(last))
        for step in range(1, int(rows.max())):
            on = left > step
            last, back, left = last[on], back[on], left[on]
            a, b, c, d = passage[last - step + 1].T
            back = leave[last - step] = (c + d * back) / (a + b * back)
    return np.concatenate([forward_backward(emissions[p], lengths[p], transitions, enter[p], leave[p], False)[0] for p in parts]) if n else emissions


def _segments(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One text's values as rows of SEGMENT, padded with 0, and the rows' lengths."""
    rows = -(-len(values) // SEGMENT)
    padded = np.zeros(rows * SEGMENT, dtype=values.dtype)
    padded[: len(values)] = values
    lengths = np.full(rows, SEGMENT)
    if rows:
        lengths[-1] = len(values) - (rows - 1) * SEGMENT
    return padded.reshape(rows, SEGMENT), lengths


def summary(probability: np.ndarray) -> tuple[float, float]:
    """What the calibration sees of a text: its greatest marginal, and the log of the expected number of toxic words among the likely ones."""
    if not len(probability):
        return 0.0, 0.0
    return float(probability.max()), float(np.log1p(probability[probability >= 0.5].sum()))


def _distinct(rows: list[tuple[str, int]]) -> list[tuple[list[str], int]]:
    """Texts as words, without copies and near copies: those of whose word 5-grams half or more are another's, by 64 least hashes.

    Texts that share no more than a passage are different texts.
    """
    salts = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out, known = [], {}
    least = np.zeros((64, 64), dtype=np.uint64)  # of the texts taken, and room for more
    for text, toxic in sorted({(t or "", y) for t, y in rows}):
        w = [known.setdefault(x, x) for x in words(text)]
        if not w:
            continue
        grams = np.array([xxhash.xxh3_64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))], dtype=np.uint64)
        own = mix64(grams[:, None] ^ salts).min(axis=0)
        if not len(out) or (least[: len(out)] == own).sum(axis=1).max() < 32:
            if len(out) == len(least):
                least = np.concatenate([least, np.zeros_like(least)])
            least[len(out)] = own
            out.append((w, toxic))
    return out


def _fresh(texts: list[tuple[list[str], int]]) -> list[set[str]]:
    """The words of each text that count.

    A word counts by the neighbours it stands between. What a clean text shows counts once
    for each label, so a passage that both labels share proves nothing; what toxic texts
    alone show, such as a copied insult, counts in every text that has it.
    """
    number: dict[str, int] = {}
    hashes, sizes = [], []
    for w, _ in texts:
        n = np.array([0, *(number.setdefault(x, len(number) + 1) for x in w), 0], dtype=np.uint64)
        hashes.append(mix64(n[1:-1] + mix64(n[:-2] + mix64(n[2:]))))
        sizes.append(len(w))
    toxic = np.repeat(np.array([y > 0 for _, y in texts], dtype=bool), sizes)
    _, place = np.unique(np.concatenate(hashes), return_inverse=True)
    clean = np.zeros(len(place), dtype=bool)
    clean[place[~toxic]] = True
    counted = ~clean[place]
    counted[np.unique(2 * place + toxic, return_index=True)[1]] = True
    ends = np.cumsum(sizes)
    return [{w[i] for i in np.flatnonzero(counted[e - len(w) : e]).tolist()} for (w, _), e in zip(texts, ends)]


def _seeds(texts: list[tuple[list[str], int]]) -> set[str]:
    """Features that labelled texts tie to toxicity: a log-likelihood ratio of 20 or more (about one in 100,000 by chance) and 8 times the share."""
    counts = (Counter(), Counter())
    totals = [sum(1 for _, y in texts if y == k) for k in (0, 1)]
    fresh = _fresh(texts)
    toxic = {f for w, (_, y) in zip(fresh, texts) if y for x in w for f in features(x) if f[0] != "s"}
    for w, (_, y) in zip(fresh, texts):
        counts[y].update({f for x in w for f in features(x) if f in toxic})
    out = set()
    for f, a in counts[1].items():
        b = counts[0][f]
        pa_, pb, p = a / max(1, totals[1]), b / max(1, totals[0]), (a + b) / (totals[0] + totals[1])
        if pa_ < 8 * pb or a < 3:
            continue

        def ll(k, n, q):
            return k * np.log(max(q, 1e-12)) + (n - k) * np.log(max(1 - q, 1e-12))

        if 2 * (ll(a, totals[1], pa_) + ll(b, totals[0], pb) - ll(a, totals[1], p) - ll(b, totals[0], p)) >= 20:
            out.add(f)
    return out


def _fit_chain(segments: list[tuple[list[str], np.ndarray]], rounds: int = 40) -> tuple[dict[str, float], float, np.ndarray]:
    """Maximise the CRF's penalised likelihood by AdaGrad on all segments, BLOCK of them at a time.

    A place holds the number of its word, and features belong to words: what is held grows by a few bytes with a place.
    """
    index: dict[str, int] = {}
    number: dict[str, int] = {}
    ids, sizes = [], []
    lengths = np.array([len(w) for w, _ in segments])
    gold = np.zeros((len(segments), SEGMENT), dtype=bool)
    word = np.zeros((len(segments), SEGMENT), dtype=np.int32)
    for r, (w, y) in enumerate(segments):
        gold[r, : len(w)] = y
        for i, x in enumerate(w):
            k = number.get(x)
            if k is None:
                k = number[x] = len(number)
                own = [index.setdefault(f, len(index)) for f in features(x)]
                ids += own
                sizes.append(len(own))
            word[r, i] = k
    ids, owner = np.array(ids, dtype=np.int32), np.repeat(np.arange(len(number), dtype=np.int32), sizes)
    theta, bias, move = np.zeros(len(index)), -2.0, np.zeros((2, 2))
    g_theta, g_bias, g_move = np.full(len(index), 1e-3), 1e-3, np.full((2, 2), 1e-3)
    inside = np.arange(SEGMENT)[None, :] < lengths[:, None]
    steps = inside[:, 1:]
    gold_move = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            gold_move[a, b] = ((gold[:, :-1] == a) & (gold[:, 1:] == b) & steps).sum()
    for _ in range(rounds):
        score = np.bincount(owner, weights=theta[ids], minlength=len(number)) + bias
        by_word, expected = np.zeros(len(number)), np.zeros((2, 2))
        for low in range(0, len(segments), BLOCK):
            part = slice(low, low + BLOCK)
            p, moved = forward_backward(score[word[part]], lengths[part], move)
            expected += moved
            d = np.where(inside[part], gold[part] - p, 0.0)
            by_word += np.bincount(word[part].ravel(), weights=d.ravel(), minlength=len(number))
        grad = np.bincount(ids, weights=by_word[owner], minlength=len(theta)) - 0.02 * theta
        g_theta += grad**2
        theta += 0.5 * grad / np.sqrt(g_theta)
        db = by_word.sum()
        g_bias += db**2
        bias += 0.5 * db / np.sqrt(g_bias)
        gm = gold_move - expected - 1.0 * move
        g_move += gm**2
        move += 0.2 * gm / np.sqrt(g_move)
    return {f: float(theta[i]) for f, i in index.items() if abs(theta[i]) > 1e-3}, float(bias), move


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression on (1, greatest marginal, log expected words) by damped Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(50):
        p = sigmoid(x @ w)
        g = x.T @ (y - p) - 0.01 * w * [0, 1, 1]
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3)
        w += np.linalg.solve(h, g)
    return w


def train(rows: list[tuple[str, int]]) -> Model:
    """Fit on every segment of (text, label) pairs; without toxic ones, or without clean ones, every text gets the labels' share (0 for no labels)."""
    known = _distinct(rows)
    share = (sum(y for _, y in known) + 0.5) / (len(known) + 1) if known else 1e-6
    blank = Model({}, -20.0, np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    if len({y for _, y in known}) < 2:
        return blank
    seeds = _seeds(known)
    if not seeds:
        return blank
    toxic_word = Memo(lambda w: any(f in seeds for f in features(w)))
    segments = []
    for w, y in known:
        marks = np.array([bool(y) and toxic_word[x] for x in w])
        segments += [(w[i : i + SEGMENT], marks[i : i + SEGMENT]) for i in range(0, len(w), SEGMENT)]
    weights, bias, move = _fit_chain(segments)
    model = Model(weights, bias, move, np.zeros(3))
    score = Memo(model.emission)
    laid = [_segments(np.array([score[x] for x in w], dtype=np.float64)) for w, _ in known]
    rows = np.array([len(n) for _, n in laid])
    p = marginals(np.concatenate([e for e, _ in laid]), np.concatenate([n for _, n in laid]), move, rows)
    seen = [summary(p[end - n : end].ravel()) for n, end in zip(rows, np.cumsum(rows))]
    model.calibration = _calibrate(np.array(seen), np.array([y for _, y in known], dtype=float))
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str) -> list[tuple[str, int]]:
    """At most MOST_TOXIC and MOST_CLEAN texts (those of least id hash), none held out.

    They are whole texts of any length, the shortest of each label until TOXIC_CHARS and
    CLEAN_CHARS characters are together, one at least; the rest is only scored. Repeated labels of a document count as toxic if any does; null labels and ids count as none.
    Of different texts that share an id the least one is taken.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    rank, counts = F.xxhash64(id_col, F.lit("sample")), {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    # some more than wanted by their hash, wherever they are, so that the limit is not taken from every task
    near = lambda y, most: known.filter(F.col("y") == y).filter(hashed_share((1.2 * most + 100) / max(1, counts.get(y, 0)), id_col)).orderBy(rank, id_col).limit(most)
    short = near(1, MOST_TOXIC).unionByName(near(0, MOST_CLEAN))
    # its rows are bounded above: a broadcast of some ten thousand ids
    ids = short.select(F.col(id_col).alias("__id"), F.col("y").alias("__y"))
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("__doc"), text.alias("__text")).filter("__text is not null")
    # a text counts once, however many rows repeat its id: what is read stays bounded by the sample
    found = rows.join(F.broadcast(ids), F.col("__doc") == F.col("__id")).groupBy("__doc", "__y").agg(F.min("__text").alias("__text"))
    shorter = Window.partitionBy("__y").orderBy(F.length("__text"), "__doc").rowsBetween(Window.unboundedPreceding, -1)  # over the sample's rows alone
    room = F.when(F.col("__y") == 1, TOXIC_CHARS).otherwise(CLEAN_CHARS)
    found = found.withColumn("__before", F.coalesce(F.sum(F.length("__text")).over(shorter), F.lit(0))).filter(F.col("__before") < room).select("__text", "__y").toArrow()
    return list(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))


class Judge:
    """A model at work in one task."""

    def __init__(self, model: Model):
        self.model, self.emission = model, Memo(model.emission)

    def marginals_and_scores(self, texts: list[str]):
        """(text, toxic marginals of its words, score) of each text, a bounded number of segments at a time."""
        waiting, held = [], 0
        for t in texts:
            w = WORD.findall(t.lower())
            e, n = _segments(np.fromiter(map(self.emission.__getitem__, w), dtype=np.float64, count=len(w)))
            waiting.append((t, e, n))
            held += len(n)
            if held >= BLOCK:
                yield from self._score(waiting)
                waiting, held = [], 0
        yield from self._score(waiting)

    def _score(self, waiting):
        if not waiting:
            return
        e, n = np.concatenate([x[1] for x in waiting]), np.concatenate([x[2] for x in waiting])
        p = marginals(e, n, self.model.transitions, np.array([len(x[2]) for x in waiting]))
        at = 0
        for t, _, own in waiting:
            values = p[at : at + len(own)].ravel()
            at += len(own)
            yield t, values, float(sigmoid(np.array([1.0, *summary(values)]) @ self.model.calibration))


def tag(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", span: float = 0.5) -> DataFrame:
    """Score every whole text and name its offending words.

    Returns (id_col, score, spans): spans is an array of (start, end, p) in characters
    for each word whose toxic marginal is at least `span`. A null text is empty: no
    spans, and the score of a text without toxic words.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the training sample

    def score(batches):
        judge = Judge(shared.value)
        for batch in slices(batches):
            scores, spans = [], []
            for t, own, value in judge.marginals_and_scores(list(texts(batch.column("text")))):
                scores.append(value)
                # a word's place is looked up in the text itself, where lower-casing may have other lengths
                hit = set(np.flatnonzero(own >= span).tolist())
                spans.append([{"start": a, "end": b, "p": float(own[k])} for k, a, b in _places(t, hit)] if hit else [])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=[id_col, "score", "spans"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        score, f"`{id_col}` {id_type}, score double, spans array<struct<start: long, end: long, p: double>>"
    )


def _places(text: str, hits: set[int]):
    """(word number, start, end) of the chosen words of the lower-cased text, as places in the text itself."""
    low = text.lower()
    if len(low) == len(text):
        place = lambda i: i
    else:
        at = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text]).tolist() + [len(text)]
        place = at.__getitem__ if len(at) == len(low) + 1 else lambda i: min(i, len(text))
    for k, m in enumerate(WORD.finditer(low)):
        if k in hits:
            yield k, place(m.start()), place(m.end())


def score_toxicity(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", span: float = 0.5
) -> DataFrame:
    """Fit the CRF on a bounded sample of labelled texts that are not held out, and tag every document.

    Only texts are inputs of a score. Repeated rows and null ids are scored each; an
    empty table gives no rows; without labels every score is near 0. Other columns of
    docs play no part. Returns (id_col, score, spans).
    """
    model = train(labelled_sample(docs, labels, text_col, id_col, label_col))
    return tag(docs, model, text_col, id_col, span)


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", reject: float = REJECT) -> DataFrame:
    """The rows of docs that score below `reject`, whole and unshuffled; see score_toxicity."""
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled_sample(docs, labels, text_col, id_col, label_col)))

    def make_keep():
        judge = Judge(shared.value)
        return lambda texts: [score < reject for _, _, score in judge.marginals_and_scores(texts)]

    return filter_rows(docs, text_col, make_keep)
