"""Nearest neighbours by recall against brute force, and importance resampling against a plain rerun."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from slabwise.llm import ann, resample
from slabwise.llm.common import table
from slabwise.session import ship

CLASHING = ("id", "v", "g", "list", "side", "score", "rank", "query_id", "kth", "ids", "n_words", "name", "weight", "above", "bucket")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def with_clashing(df):
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


# ---- nearest neighbours --------------------------------------------------------------------------
def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(rows, queries, k=10):
    """{query: [(distance, id)]} over usable rows; a repeated query id asks by its least vector."""
    width = max((len(v) for _, v in rows if v), default=1)
    usable = lambda i, v: i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    rows = [(i, np.pad(np.array(v, dtype=np.float32).astype(np.float64), (0, width - len(v)))) for i, v in rows if usable(i, v)]
    ids, m = np.array([i for i, _ in rows], dtype=np.int64), np.array([v for _, v in rows]).reshape(len(rows), width)
    out = {}
    for q in {i for i in queries if i in set(ids.tolist())}:
        own = m[min(np.flatnonzero(ids == q), key=lambda x: m[x].tolist())]
        d = np.sqrt(((m - own) ** 2).sum(axis=1))
        near = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(d[j], int(ids[j])) for j in near]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r.query_id, [])
        own.append((r.score, r.vec_id))
        assert r["rank"] == len(own)
    return out


def recall(got, want):
    return sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want) / sum(map(len, want.values()))


def test_recall_on_spread_vectors(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, [i for i, _ in rows if i % 100 == 0])
    got = found(ann.nearest(df, df.filter("vec_id % 100 = 0")))
    assert set(got) == set(want) and all(len(x) == 10 and x == sorted(x) for x in got.values())
    assert recall(got, want) >= 0.9
    exact = {(q, i): d for q, x in want.items() for d, i in x}
    assert all(abs(exact[q, i] - d) <= 1e-12 for q, x in got.items() for d, i in x if (q, i) in exact)


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    spots = rng.standard_normal((60, 32)) * 4
    rows = [(i, (spots[i % 60] + rng.standard_normal(32) * 0.5).astype(np.float32).tolist()) for i in range(6000)]
    rows += [(6000 + i, rows[5][1]) for i in range(3000)]  # a third of all rows is one vector
    return rows


def test_recall_with_clusters_and_a_crowd_of_copies(spark, clustered):
    df = vectors_of(spark, clustered)
    want = brute(clustered, range(0, 9000, 100))
    index = ann.Index(df, "vec_id", "embedding")
    assert index.parts.max() > 1  # the copies' list is spread over groups
    probes = ann.probes_for(index, 10, ann.RECALL)
    assert probes < len(index.centres) / 4
    got = found(ann.nearest(df, df.filter("vec_id % 100 = 0")))
    assert recall(got, want) >= 0.95
    assert all(got[q] == want[q] for q in range(6000, 9000, 100))  # ties of distance 0 go to the least ids


def test_tests_abandon_most_candidates_early(clustered):
    m = np.array([v for _, v in clustered[:6000]], dtype=np.float32)
    turned = (m.astype(np.float64) @ ann._rotation(32)).astype(np.float32)
    q = m[:30].astype(np.float64)
    d = np.sqrt(((m[None].astype(np.float64) - q[:, None]) ** 2).sum(axis=2))
    kth = np.sort(d, axis=1)[:, 10]
    scanned = np.zeros(2, dtype=np.int64)
    i, j, got = ann._scan(q, turned[:30], kth, m, np.ascontiguousarray(turned.T), scanned)
    assert scanned[0] == 30 * 6000 and scanned[1] < 0.05 * scanned[0]
    kept = set(zip(i.tolist(), j.tolist()))
    near = {(a, b) for a in range(30) for b in np.flatnonzero(d[a] <= kth[a]).tolist()}
    assert len(near & kept) >= 0.97 * len(near) and np.allclose(got, d[i, j], atol=1e-12, rtol=0)


def test_all_lists_and_a_wide_test_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "WIDTH", 50.0)
    rng = random.Random(8)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(rng.choice((3, 4)))]) for i in range(400)]  # many ties
    rows += [(7, [1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (None, [1.0, 2.0, 3.0]), (500, None), (600, []), (700, [0.0, 0.0]), (800, [1.0, None, 2.0]), (900, [float("nan"), 1.0]), (1000, [float("inf")])]
    df = with_clashing(vectors_of(spark, rows))
    queries = [i for i, _ in rows if i is not None and i % 7 == 0]
    got = found(ann.nearest(df, df.filter("vec_id % 7 = 0"), lists=9, probes=9))
    assert got == brute(rows, queries)


def test_few_and_no_candidates(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(5).astype(np.float32).tolist()) for i in range(8)]
    df = vectors_of(spark, rows)
    assert found(ann.nearest(df, df, lists=3, probes=1)) == brute(rows, range(8))  # seven neighbours each, from all lists
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0
    one = df.filter("vec_id = 0")
    assert ann.nearest(one, one).count() == 0
    far = vectors_of(spark, [(0, [3e38, -3e38]), (1, [-3e38, 3e38]), (2, [1.0, 1.0])])
    assert [r.vec_id for r in ann.nearest(far, far.filter("vec_id = 2")).orderBy("rank").collect()] == [0, 1]
    longer = spark.createDataFrame([(3, [1.0] * 9)], "vec_id long, embedding array<float>")
    assert ann.nearest(df, longer).count() == 8 - 1


# ---- importance resampling -----------------------------------------------------------------------
def plain(docs, target, percent=10, least=20, buckets=10_000, run=1, seed=2024):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, run + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(b for x in texts for b in features(x)[1]) for texts in ([x for _, x in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    rows = []
    for i, text in docs:
        w, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((j for j, r in enumerate(rows) if r[1] >= least), key=lambda j: (-rows[j][4], rows[j][0] is None, rows[j][0] or 0))
    rank = {j: place + 1 for place, j in enumerate(order[: len(order) * percent // 100])}
    return Counter((r[0], r[2], r[3], r[4], rank.get(j)) for j, r in enumerate(rows))


def odd_texts():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdeXYZé漢0") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    docs = [(i, rnd.choice((" ", "_", "\n", "'"))  .join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60)))) for i in range(500)]
    docs += [(500 + i, docs[3][1]) for i in range(250)]  # copies of one text
    docs += [(9, "a b"), (9, "a b"), (None, None), (None, " ".join(vocabulary)), (1000, ""), (1001, None), (1002, " ".join(rnd.choice(vocabulary) for _ in range(60_000))), (1003, "x" * 5000)]
    return docs, [" ".join(rnd.choice(vocabulary[:60]) for _ in range(50)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("options", [{}, {"run": 3, "percent": 37, "buckets": 64}, {"percent": 100, "least": 0}])
def test_resampling_equals_a_plain_rerun(spark, monkeypatch, options):
    docs, target = odd_texts()
    df = with_clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    named = {{"least": "least_words"}.get(k, k): v for k, v in options.items()}
    out = resample.resample(df, goal, **named)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in out.dtypes} == {"bigint"}
    assert Counter(tuple(r) for r in out.collect()) == plain(docs, target, **options)


def test_texts_are_cut_in_pieces():
    rnd = random.Random(2)
    text = " ".join("w" * rnd.randint(1, 30) + rnd.choice(("é", "", "_")) for _ in range(500))
    whole = [w for part in resample.words_in_pieces(text) for w in part]
    for piece in (1, 7, 64, 1000):
        assert [w for part in resample.words_in_pieces(text, piece) for w in part] == whole
    assert list(resample.words_in_pieces(None)) == list(resample.words_in_pieces("")) == []


def test_nothing_to_draw(spark):
    docs = spark.createDataFrame([(1, "too short"), (2, None)], "doc_id long, text string")
    none = docs.limit(0)
    assert [r["rank"] for r in resample.resample(docs, none).collect()] == [None, None]
    assert resample.resample(none, docs).count() == 0
