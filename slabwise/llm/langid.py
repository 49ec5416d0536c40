"""Language identification in two steps: the family first, then the language within it.

Texts are vectors of hashed byte trigrams. One-versus-rest linear support vector
machines choose the family; within a family, one-versus-one machines vote for the
language.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sigmoid, slices
from .linear import fit_svm

#: Families of languages by code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "hu", "et"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ur", "pa"),
}

#: Buckets of the trigram hash, and texts of a language in the training sample.
DIMENSIONS, SAMPLE_PER_LANGUAGE = 4096, 600

UNKNOWN = "und"


def family_of(lang: str, families: dict[str, tuple[str, ...]] = FAMILIES) -> str:
    return next((f for f, codes in families.items() if lang in codes), lang)


def vectors(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Square roots of trigram shares: rows of unit length. Whole texts are read."""
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    for i, text in enumerate(texts):
        b = np.frombuffer(f"  {text.lower()} ".encode(), dtype=np.uint8)
        if len(b) < 4:
            continue
        # digits and most marks say nothing of a language: they count as blanks
        b = np.where((b >= 97) & (b <= 122) | (b >= 128), b, 32).astype(np.uint32)
        h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        counts = np.bincount(h[~((b[:-2] == 32) & (b[1:-1] == 32))] >> np.uint32(20), minlength=dimensions)
        total = counts.sum()
        if total:
            out[i] = np.sqrt(counts / total)
    return out


class Model:
    """SVM weights of the families (one against the rest) and of each pair of languages within a family."""

    def __init__(self, families: list[str], family_weights: np.ndarray, members: dict[str, list[str]], pairs: dict[tuple[str, str], tuple[np.ndarray, float]]):
        self.families, self.family_weights, self.members, self.pairs = families, family_weights, members, pairs

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.families:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        margins = x @ self.family_weights[:-1] + self.family_weights[-1]
        chosen = margins.argmax(axis=1)
        shares = sigmoid(4 * margins)
        score = shares[np.arange(len(x)), chosen] / np.maximum(shares.sum(axis=1), 1e-12) if len(self.families) > 1 else np.ones(len(x))
        out = [""] * len(x)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(chosen == f)
            langs = self.members[name]
            votes, trust = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            for i, j in combinations(range(len(langs)), 2):
                w, b = self.pairs[langs[i], langs[j]]
                m = sigmoid(4 * (x[rows] @ w + b))
                votes[:, i] += m >= 0.5
                votes[:, j] += m < 0.5
                trust[:, i] += m
                trust[:, j] += 1 - m
            # most duels won; ties by the duels' margins, then by the language's name
            best = (votes * 1000 + trust).argmax(axis=1)
            for k, r in enumerate(rows):
                out[r] = langs[best[k]]
            if len(langs) > 1:
                score[rows] *= trust[np.arange(len(rows)), best] / (len(langs) - 1)
        return out, np.clip(score, 0.0, 1.0)


def train(x: np.ndarray, langs: list[str], families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    dimensions = x.shape[1]
    lang = np.array(langs, dtype=object)
    members: dict[str, list[str]] = {}
    for name in sorted(set(langs)):
        members.setdefault(family_of(name, families), []).append(name)
    names = sorted(members)
    family = np.array([family_of(x, families) for x in langs], dtype=object)
    weights = np.zeros((dimensions + 1, len(names)), dtype=np.float32)
    for k, f in enumerate(names):
        if len(names) > 1:
            w, b = fit_svm(x, np.where(family == f, 1.0, -1.0))
            weights[:-1, k], weights[-1, k] = w, b
    pairs = {}
    for own in members.values():
        for a, b in combinations(own, 2):
            rows = np.flatnonzero((lang == a) | (lang == b))
            pairs[a, b] = fit_svm(x[rows], np.where(lang[rows] == a, 1.0, -1.0))
    return Model(names, weights, members, pairs)


def training_sample(docs: DataFrame, text_col: str, id_col: str, lang_col: str) -> tuple[np.ndarray, list[str]]:
    """The vectors and languages of about SAMPLE_PER_LANGUAGE texts of each language, chosen by hash: none held out or without a letter.

    The counts cover all rows; a language's share of hashes that it keeps follows from its count. Rows that repeat id, text
    and language count once. Whole texts are turned into vectors where they are, so their lengths don't matter.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("id") & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return np.zeros((0, DIMENSIONS), np.float32), []
    space = 1_000_000_000
    keep = F.lit(0)
    for lang, n in sorted(counts.items()):
        keep = F.when(F.col("lang") == lang, F.lit(min(space, int(space * 1.1 * SAMPLE_PER_LANGUAGE / n) + 1))).otherwise(keep)
    sample = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(space)) < keep).dropDuplicates()

    def vector(batches):
        for batch in slices(batches, 64):
            x = vectors([t.as_py() for t in batch.column("text")])
            filled = [np.flatnonzero(row) for row in x]
            place, value = [i.astype(np.uint16).tobytes() for i in filled], [row[i].tobytes() for row, i in zip(x, filled)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(place, pa.binary()), pa.array(value, pa.binary())], names=["lang", "place", "value"])

    found = sample.select("text", "lang").mapInArrow(vector, "lang string, place binary, value binary").toArrow()
    both = sorted(set(zip(*(found.column(c).to_pylist() for c in ("lang", "place", "value")))))
    x = np.zeros((len(both), DIMENSIONS), np.float32)
    for i, (_, place, value) in enumerate(both):
        x[i, np.frombuffer(place, np.uint16)] = np.frombuffer(value, np.float32)
    return x, [lang for lang, _, _ in both]


def identify(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", families: dict[str, tuple[str, ...]] = FAMILIES) -> DataFrame:
    """Predict the language of every whole text.

    The machines learn from the texts and languages of a bounded sample of rows that
    are not held out. A text that is null or has no letter is `und` with score 0, as is
    every text where nothing could be learned. Repeated rows and null ids are predicted
    each; an empty table gives no rows. Returns (id_col, lang_pred, score).
    """
    x, langs = training_sample(docs, text_col, id_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(train(x, langs, families) if langs else Model([], np.zeros((0, 0)), {}, {}))
    id_type = docs.schema[id_col].dataType.simpleString()

    def predict(batches):
        model = shared.value
        for batch in batches:
            langs, scores = [], []
            for low in range(0, batch.num_rows, 512):
                part = [x.as_py() or "" for x in batch.column("text").slice(low, 512)]
                lettered = [any(map(str.isalpha, t)) for t in part]
                found, score = model.predict(vectors(part))
                langs += [f if ok else UNKNOWN for f, ok in zip(found, lettered)]
                scores += [float(s) if ok else 0.0 for s, ok in zip(score, lettered)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(predict, f"`{id_col}` {id_type}, lang_pred string, score double")
