"""The operators against brute force, exact round trips and planted cases; nulls, ties, repeats, empty and clashing inputs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from slabwise.llm import decontam, langid, linededup, ngramjoin, packing, pii, quality, topk, toxicity, urlfilter, words
from slabwise.llm.common import connected_components, rows_with_keys
from slabwise.session import ship

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def docs_of(spark, texts, extra=False):
    """Documents 0, 1, ...; extra adds columns whose names operators use inside."""
    rows = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    if extra:
        for c in ("id", "node", "label", "score", "host", "key", "tkey", "term", "lines", "row", "length", "part", "copies", "kept", "at"):
            df = df.withColumn(c, F.lit("x"))
    return df


def prose(rnd, n, size=400):
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(size)]
    return " ".join(rnd.choice(vocabulary) for _ in range(n))


# ---- packing -------------------------------------------------------------------------------------
def optimum(items, capacity):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= items[i]:
                bins[k] -= items[i]
                place(i + 1, bins)
                bins[k] += items[i]
        place(i + 1, [*bins, capacity - items[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rnd = random.Random(0)
    for _ in range(150):
        capacity = rnd.randint(5, 30)
        items = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 8))]
        count = np.bincount(items, minlength=capacity + 1).astype(np.int64)
        fixed = []

        def fix(pattern, n):
            for s, q in pattern:
                count[s] -= q * n
            fixed.append(n)

        packing._reduce(count, capacity, fix)
        rest = [s for s in range(capacity + 1) for _ in range(int(count[s]))]
        assert (count >= 0).all() and sum(fixed) + optimum(rest, capacity) == optimum(items, capacity)


def test_plan_places_every_item_once():
    rnd = random.Random(1)
    sizes = Counter(rnd.randint(1, 1024) for _ in range(5000))
    patterns = packing.plan(sizes)
    used = Counter()
    for pattern, n in patterns.items():
        assert sum(s * q for s, q in pattern) <= 1024
        for s, q in pattern:
            used[s] += q * n
    assert used == sizes
    most = max(-(-sum(s * n for s, n in sizes.items()) // 1024), sum(n for s, n in sizes.items() if s > 512))
    assert sum(patterns.values()) <= 1.01 * most


def test_packed_sequences_are_gapless_and_carry_the_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rnd = random.Random(2)
    texts = [prose(rnd, n) for n in (1, 5, 30, 200, 900, 3000)] + [None, "", "été 日本 \x1c  \n\n 'll 123", "same", "same", "word" * 2000]
    texts += ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|> x  <|endoftext|><|endoftext|>\n", "end  <|endoftext|>", "<|endoftext|", " " * 1_000_000, "<|endoftext|>" * 1500]
    got = packing.pack(docs_of(spark, texts, extra=True)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:]) and (len(ids) > 1024 or len(own) == 1)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing_nothing(spark):
    assert packing.pack(docs_of(spark, [])).count() == 0


# ---- urls ----------------------------------------------------------------------------------------
def judged(url, rules):
    host = path = ""
    if url is not None and (m := re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)):
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls_against_every_rule(spark):
    rnd = random.Random(3)
    part = lambda: rnd.choice(["a", "b", "net", "x-y", "c"])
    rules = [("net", "/", "block"), ("a.net", "/en/", "allow"), ("b.a.net", "/e", "block"), ("org", "", "block"), ("x-y.org", "/q", "allow")]
    urls = [f"http://{'.'.join(part() for _ in range(rnd.randint(1, 4)))}{rnd.choice(['', '/', '/en/1', '/e', '/q?x', '#f'])}" for _ in range(300)]
    urls += ["HTTPS://B.A.NET/en/É", "no scheme", "", None, "://", "http://?q", "http://a.net\n/en/", "http://org/q", "http://org/q"]
    urls += ["http://hot.a.net/en/z"] * 200
    df = spark.createDataFrame([(i if i % 9 else None, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(df, table).collect())
    assert got == Counter((i if i % 9 else None, *judged(u, rules)) for i, u in enumerate(urls))
    assert urlfilter.filter_urls(df.limit(0), table).count() == 0
    assert urlfilter.filter_urls(df, table.limit(0)).filter("rule is not null or verdict <> 'allow'").count() == 0


# ---- personal data -------------------------------------------------------------------------------
def naive_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rnd = random.Random(4)
    for _ in range(5000):
        t = "".join(rnd.choice("a@.1259 +-()é@.") for _ in range(rnd.randrange(40)))
        assert [s[:3] for s in pii.base_spans(t)] == naive_spans(t)
    for t in ("9" * 100_000, "a" * 100_000, "@" * 100_000, "1." * 50_000, "+1" + " " * 100_000):
        pii.base_spans(t)  # linear time


def test_revealing_words_are_found_and_sanitised(spark):
    rnd = random.Random(5)
    texts = [f"{prose(rnd, 30)} boss zorgblat writes from jane.doe@mail.example.org to {prose(rnd, 30)}" for _ in range(6)] + [prose(rnd, 60) for _ in range(200)]
    texts += [None, "", "4111 1111 1111 1111 é +49 (30) 123456-7 10.0.0.256 10.0.0.25", texts[0]]
    df = docs_of(spark, texts, extra=True)
    got = {r.doc_id: r for r in pii.find_personal(df).withColumn("listed", pii.listed("spans")).collect()}
    for i, t in enumerate(texts):
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in naive_spans(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [s for s in got[i].listed.split(",") if s and s.split(":")[0] in pii.KINDS[:4]] == [s for s in base.split(",") if s]
    hit = [t for t in got[0].listed.split(",") if t.startswith(("remove", "general"))]
    assert any(texts[0][int(a) : int(b)] == "zorgblat" for _, a, b in (h.split(":") for h in hit))
    assert all(not got[i].listed for i in range(6, 206))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "zorgblat" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == texts[10] and clean[206] is None
    assert pii.sanitise(df).columns == df.columns and pii.find_personal(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("most", [500_000, 0])
def test_revealing_words_count_over_whole_documents(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
    rnd = random.Random(23)
    far = [f"李明 wrote. {prose(rnd, 40)} jane.doe@mail.example.org {prose(rnd, 40)} acct_77x Zorgblat {prose(rnd, 20)} zorgblat" for _ in range(6)]
    texts = far + [f"{prose(rnd, 60)} doe" for _ in range(200)] + [f"{prose(rnd, 20)} {w} zorgblat" for w in ("a1", "b2")]
    got = {r.doc_id: r.spans for r in pii.find_personal(docs_of(spark, texts)).collect()}
    for i in range(6):
        hit = [(texts[i][x.s : x.e].lower(), pii.KINDS[x.k]) for x in got[i] if pii.KINDS[x.k] in ("general", "remove")]
        assert {("李明", "remove"), ("acct_77x", "remove")} <= set(hit)
        assert [k for w, k in hit if w == "zorgblat"] == ["general"] * 2  # log(208 * 6 / (6 * 8)) / log(208 / 6) = 0.92
    assert all(not got[i] for i in range(6, len(texts)))


def test_word_counts_are_the_same_with_and_without_a_broadcast(spark, monkeypatch):
    rnd = random.Random(14)
    texts = [prose(rnd, 40, 100) for _ in range(30)] + [None]
    df = docs_of(spark, texts)
    vocabulary = sorted({w for t in texts if t for w in re.findall(r"[^\W\d_]{3,}", t)})[::3]
    terms = spark.createDataFrame([(w,) for w in vocabulary], "term string")
    want = {(w, sum(w in re.findall(r"[^\W\d_]{3,}", t) for t in texts if t)) for w in vocabulary}
    assert {tuple(r) for r in pii.document_frequencies(df, "text", terms).collect()} == want
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(pii, "HELD_TERMS", 10)
    assert {tuple(r) for r in pii.document_frequencies(df, "text", terms).collect()} == want


def test_revealing_words_equal_brute_force(spark):
    """The whole method by naive counting over the fixture's documents, with some copies and a signature added."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(10_000 + i, f"Quibbert zulu{i % 5} wrote 10.1.1.{i % 3} to ann@b.example.org {i}") for i in range(12)]
    rows += [(20_000 + i, rows[-1][1]) for i in range(4)]
    loose = {t: {w for w, _, _ in pii.loose_terms(t or "", pii.base_spans(t or ""))} for _, t in rows}
    held = {t: {f"{pii.KINDS[k]}:{v}" for _, k, _, v in pii.base_spans(t or "")} | {pii.KINDS[k] for _, k, _, _ in pii.base_spans(t or "")} for _, t in rows}
    n_term, n_entity, both = Counter(), Counter(), Counter()
    in_texts, shown = defaultdict(set), defaultdict(set)
    for _, t in rows:
        n_term.update(loose[t])
        n_entity.update(held[t])
        for e in held[t]:
            in_texts[e].add(t)
            both.update((e, w) for w in loose[t])
            for w in loose[t]:
                shown[e, w].add(t)
    kind = {}
    for (e, w), n in both.items():
        own = np.log(len(rows) / n_entity[e])
        if own > 0 and len(in_texts[e]) >= 3 and len(shown[e, w]) >= 3:
            share = np.log(len(rows) * n / (n_entity[e] * n_term[w])) / own
            assert min(abs(share - pii.GENERALISE), abs(share - pii.REMOVE)) > 1e-9
            if share >= pii.GENERALISE:
                kind[e, w] = 5 if share >= pii.REMOVE else 4
    want = {}
    for i, t in rows:
        spans = pii.base_spans(t or "")
        marked = [(a, max((kind.get((e, w), -1) for e in held[t]), default=-1), b) for w, a, b in pii.loose_terms(t or "", spans)]
        want[i] = sorted([(a, k, b) for a, k, b, _ in spans] + [x for x in marked if x[1] >= 0])
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and any(k >= 4 for spans in want.values() for _, k, _ in spans)


# ---- toxicity ------------------------------------------------------------------------------------
def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    e, move, lengths = rng.normal(size=(3, 5)), rng.normal(size=(2, 2)), np.array([5, 3, 1])
    p, pairs = toxicity.forward_backward(e, lengths, move)
    want, moves = np.zeros((3, 5)), np.zeros((2, 2))
    for r, n in enumerate(lengths):
        paths = list(itertools.product((0, 1), repeat=int(n)))
        weight = np.array([np.exp(sum(e[r, i] * y[i] for i in range(n)) + sum(move[y[i], y[i + 1]] for i in range(n - 1))) for y in paths])
        weight /= weight.sum()
        for y, w in zip(paths, weight):
            want[r, :n] += w * np.array(y)
            for i in range(n - 1):
                moves[y[i], y[i + 1]] += w
    assert np.abs(p - want).max() < 1e-12 and np.abs(pairs - moves).max() < 1e-12


def test_chains_go_on_across_segments():
    rng = np.random.default_rng(4)
    move = rng.normal(size=(2, 2))
    sizes = [1, 64, 65, 200, 0, 64 * 3, 1000]
    texts = [3 * rng.normal(size=n) for n in sizes]
    cut_up = [toxicity._segments(x) for x in texts]
    got = toxicity.marginals(np.concatenate([e for e, _ in cut_up]), np.concatenate([n for _, n in cut_up]), move, np.array([len(n) for _, n in cut_up]))
    at = 0
    for x, (e, _) in zip(texts, cut_up):
        own = got[at : at + len(e)].ravel()[: len(x)]
        at += len(e)
        want = toxicity.forward_backward(x[None, :], np.array([len(x)]), move)[0][0] if len(x) else own
        assert np.abs(own - want).max(initial=0) < 1e-9


def toxic_corpus(rnd, n):
    out = []
    for i in range(n):
        w = prose(rnd, rnd.randint(20, 80)).split()
        y = i % 4 == 0
        for _ in range(3 * y):
            w.insert(rnd.randrange(len(w)), rnd.choice(["morongo", "scumbly", "idiotic"]))
        out.append((" ".join(w), int(y)))
    return out


def test_toxic_documents_are_scored_with_their_spans(spark):
    rnd = random.Random(6)
    made = toxic_corpus(rnd, 400)
    texts = [t for t, _ in made] + [None, "", "... 123 ...", "İ İ scumbly morongo x", "clean words only"]
    df = docs_of(spark, texts, extra=True)
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(made)] + [(0, 1, 0), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i].score >= 0.3) == made[i][1] for i in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert not got[400].spans and not got[401].spans and got[400].score == got[401].score < 0.3
    assert [texts[403][s.start : s.end] for s in got[403].spans] == ["scumbly", "morongo"]
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r.score < 0.3}


def test_scores_equal_a_plain_rerun(spark):
    """Every document of the fixture scored once more as one chain from its first word to its last, by a model of the same rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: int(r.toxic > 0) for r in labels.collect() if r.doc_id is not None and r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    model = toxicity.train([(text[i], y) for i, y in known.items() if text.get(i) is not None])
    got = {r.doc_id: (r.score, r.spans) for r in toxicity.score_toxicity(docs, labels).collect()}
    for i, t in text.items():
        e = np.array([model.emission(w) for w in words.words(t)])
        p = toxicity.forward_backward(e[None, :], np.array([len(e)]), model.transitions)[0][0] if len(e) else e
        score = 1 / (1 + np.exp(-np.array([1.0, *toxicity.summary(p)]) @ model.calibration))
        assert abs(got[i][0] - score) < 1e-9 and len(got[i][1]) == (p >= 0.5).sum()


def test_long_toxic_texts_alone_are_learned_from(spark, monkeypatch):
    rnd = random.Random(22)
    long = lambda y: " ".join(f"{prose(rnd, 60, 500)} {'scumbly' if y else 'kindly'}" for _ in range(85))
    texts = [long(i % 2) for i in range(60)]
    assert min(map(len, texts)) > 25_000
    df = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(df, labels).collect()}
    assert all((got[i] >= 0.3) == (i % 2 == 1) for i in range(60))
    monkeypatch.setattr(toxicity, "TOXIC_CHARS", 70_000)
    monkeypatch.setattr(toxicity, "CLEAN_CHARS", 1)
    sample = toxicity.labelled_sample(df, labels, "text", "doc_id", "toxic")
    known = sorted(len(texts[i]) for i in range(1, 60, 2) if zlib.crc32(str(i).encode()) % 4 != 2)
    assert sorted(len(t) for t, y in sample if y) == known[: len([1 for k in range(len(known)) if sum(known[:k]) < 70_000])] and sum(1 - y for _, y in sample) == 1


def test_every_segment_of_the_sample_is_fitted(monkeypatch):
    rnd = random.Random(21)
    # 4,200 toxic segments; a word that only the text which sorts last shows
    texts = [(" ".join(f"w{i}x{k} scumbly" for k in range(32 * 70)), 1) for i in range(59)] + [("zz " + " ".join(f"z{k} scumbly" for k in range(32 * 70)) + " яzlast", 1)]
    texts += [(prose(rnd, 64), 0) for _ in range(100)]
    seen = []
    monkeypatch.setattr(toxicity, "_fit_chain", lambda segments: seen.extend(segments) or ({}, 0.0, np.zeros((2, 2))))
    toxicity.train(texts)
    assert sum(y.any() for _, y in seen) >= 59 * 70 + 70
    assert Counter(w for words_, _ in seen for w in words_) == Counter(w for t, _ in texts for w in words.words(t))


def test_a_passage_that_only_toxic_texts_share_is_learnt():
    rnd = random.Random(22)
    passage, boiler = "vrok zamble quint ferrow dask", "all rights reserved by the owner"
    made = [(f"{prose(rnd, 40)} {boiler} {prose(rnd, 10)}" + i % 4 // 3 * f" {passage} {prose(rnd, 10)}", i % 4 // 3) for i in range(400)]
    copied = prose(rnd, 60, 4000)
    made += [(f"{copied} {i}", 1) for i in range(40)]  # near copies of a whole text are one text
    seeds = toxicity._seeds(toxicity._distinct(made))
    assert {f"w:{x}" for x in passage.split()} <= seeds and not {f"w:{x}" for x in (boiler + " " + copied).split()} & seeds
    judge = toxicity.Judge(toxicity.train(made))
    tests = [(f"{prose(rnd, 50)} {boiler}" + y * f" {passage} {prose(rnd, 10)}", y) for y in (0, 1) * 40]
    assert all((score >= toxicity.REJECT) == bool(y) for (_, _, score), (_, y) in zip(judge.marginals_and_scores([t for t, _ in tests]), tests))


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs_of(spark, ["a b c", None]), labels).filter("score >= 0.3").count() == 0
    assert toxicity.score_toxicity(docs_of(spark, []), labels).count() == 0


# ---- decontamination -----------------------------------------------------------------------------
def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_nearest_window_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(100):
        item, stretch = rng.integers(0, 4, rng.integers(1, 7)), rng.integers(0, 4, rng.integers(1, 12))
        want = min(edit_distance(item.tolist(), stretch[i:j].tolist()) for i in range(len(stretch) + 1) for j in range(i, len(stretch) + 1))
        distance, start = decontam.nearest(item, stretch)
        assert distance == want
        assert any(edit_distance(item.tolist(), stretch[start:j].tolist()) == want for j in range(start, len(stretch) + 1))


def test_leaks_are_found_and_clean_documents_stay(spark):
    rnd = random.Random(7)
    items = [prose(rnd, rnd.randint(12, 60), 5000) for _ in range(40)]
    texts, leaks = [], {}
    for i in range(120):
        body = prose(rnd, 80, 5000).split()
        if i % 3 == 0:
            k = i // 3
            w = items[k].split()
            for _ in range(int(len(w) * rnd.choice([0, 0, 0.05, 0.1, 0.15]))):
                p = rnd.randrange(len(w))
                w[p : p + rnd.randint(0, 1)] = [rnd.choice(body)] * rnd.randint(0, 1)
            body[40:40] = w
            leaks[i] = k
        texts.append(" ".join(body).upper() if i % 2 else " ".join(body))
    texts += [None, "", "one", texts[0]]
    leaks[len(texts) - 1] = 0
    df = docs_of(spark, texts, extra=True)
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(100, None), (101, ""), (None, "!!!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench).collect()}
    assert got == set(leaks.items())
    kept = decontam.drop_leaks(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - set(leaks)
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0 and decontam.drop_leaks(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.05, 0.1, 0.15, 0.2])
def test_recall_by_length_against_an_exhaustive_scan(share):
    """Items of 1 to 100 words with edits: of all that an exhaustive scan of every window finds, 0.99 or more at each length."""
    rnd = random.Random(31)
    vocabulary = [f"w{i}" for i in range(400)]
    for n in (1, 2, 3, 4, 5, 7, 9, 10, 12, 15, 25, 60, 100):
        items = [[rnd.choice(vocabulary) for _ in range(n)] for _ in range(120)]
        index = decontam.Index([(k, " ".join(w)) for k, w in enumerate(items)])
        texts = []
        for w in items:
            w = list(w)
            for _ in range(int(share * n)):
                p = rnd.randrange(len(w))
                w[p : p + rnd.randint(0, 1)] = [rnd.choice(vocabulary)] * rnd.randint(0, 1) or [w[p]]
            texts.append(" ".join([*rnd.choices(vocabulary, k=20), *w, *rnd.choices(vocabulary, k=20)]))
        found = {(i, k): d for i, k, d, _ in index.search(texts, index.coder())}
        code = [np.array([index.code.get(x, 0) for x in words.words(t)]) for t in texts]
        want = {(i, k): decontam.nearest(index.items[k], code[i])[0] for i in range(len(texts)) for k in ((i, (i + 1) % 120) if n > 4 else range(120))}
        want = {x: d for x, d in want.items() if d <= index.limit[x[1]]}
        assert all((i, i) in want for i in range(120))
        assert sum(found.get(x) == d for x, d in want.items()) >= 0.99 * len(want), (n, share)
        assert n <= 4 or all(k in (i, (i + 1) % 120) or decontam.nearest(index.items[k], code[i])[0] <= index.limit[k] for i, k in found)


def test_an_index_that_falls_short_of_its_recall_is_exact():
    rnd = random.Random(31)
    items = [[f"w{rnd.randrange(60)}" for _ in range(rnd.randint(10, 40))] for _ in range(30)]
    short = decontam.Index([(k, " ".join(w)) for k, w in enumerate(items)], functions=0)
    assert short.measured == 0 and decontam.Index([(k, " ".join(w)) for k, w in enumerate(items)]).measured >= decontam.RECALL
    rng = np.random.default_rng(4)
    copies = [short._edited(k, rng) for k in range(30) for _ in range(20)]
    found = {(t, k) for t, k, _, _ in short.matches(copies)}
    assert all((t, t // 20) in found for t in range(600))


def test_walks_are_sampled_over_the_whole_window_and_stay_in_their_text():
    """Sampled places come from all of the way to the item's end; a text has the same candidates alone and beside others; known hashes drop nothing that collides."""
    rnd = random.Random(12)
    items = [[f"w{rnd.randrange(300)}" for _ in range(n)] for n in (12, 40, 80, 200) * 10]
    index = decontam.Index([(k, " ".join(w)) for k, w in enumerate(items)], recall=1.1, functions=40)
    for n in (40, 200):
        ways = [steps for _, steps in index.anchors if steps <= n]
        assert max(ways) >= 0.8 * (n / 2 - 1)
    for c in index.anchors:
        taken = {int(j) for f in index.functions for j in f["classes"][c][0]}
        assert max(taken) > 0.8 * c[1] and min(taken) <= max(1, 0.3 * c[1])
    rng = np.random.default_rng(1)
    copies = [index._edited(k, rng)[10:-14] for k in range(len(items))]
    beside = {tuple(r) for r in index.candidates(copies).tolist()}
    alone = {(t, *r[1:]) for t, x in enumerate(copies) for r in index.candidates([x]).tolist()}
    assert beside == alone
    codes, f, c = np.concatenate(copies), index.functions[0], next(iter(index.anchors))
    sampled, known, _ = f["classes"][c]
    where = np.flatnonzero(index.is_anchor[c][codes])
    left, keys = index.walk(codes, where, c[0], f["bits"], sampled, known)
    every = index.walk(codes, where, c[0], f["bits"], sampled)[1]
    assert left.tolist() == np.flatnonzero(np.isin(every, known[-1])).tolist() and keys.tolist() == every[left].tolist()


def test_leaks_of_repeated_documents_and_items(spark):
    rnd = random.Random(18)
    item = prose(rnd, 20, 5000)
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, "")], "item_id long, text string")
    df = spark.createDataFrame([(5, f"so {item}"), (5, f"so {item}"), (None, item), (6, None), (7, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench).collect()), key=repr)
    assert got == sorted([(d, i) for d in (5, 5, None) for i in (1, 1, None)], key=repr)
    assert sorted(r.doc_id for r in decontam.drop_leaks(df, bench).collect()) == [6, 7]


def test_leaks_in_several_passes(spark, monkeypatch):
    rnd = random.Random(8)
    items = [prose(rnd, 20, 5000) for _ in range(9)]
    monkeypatch.setattr(decontam, "ITEMS_PER_PASS", 4)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = docs_of(spark, [f"{prose(rnd, 9, 5000)} {t}" for t in items] + [prose(rnd, 50, 5000)])
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench).collect()} == {(i, i) for i in range(9)}
    assert [r.doc_id for r in decontam.drop_leaks(df, bench).collect()] == [9]


# ---- lines ---------------------------------------------------------------------------------------
def test_boilerplate_by_site(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(60):
        lines = [prose(rnd, 6) for _ in range(4)]
        if i % 2 == 0:
            lines.insert(1, "Follow us ")
        rows.append((i, "\n".join(lines), "en", "a" if i < 50 else "b", 0))
    rows += [(100 + i, "exact copy\nbody", "en", "a", 0) for i in range(30)]
    rows += [(200, None, "en", None, 0), (201, "", None, None, 0), (202, "Follow us\n\nFollow us", "en", "a", 0), (202, "Follow us\n\nFollow us", "en", "a", 0)]
    df = spark.createDataFrame(rows, DOC).withColumn("lines", F.lit(1)).withColumn("host", F.lit("z"))
    got = linededup.drop_boilerplate(df, ratio=0.2, least_pages=6)
    assert got.columns == [*df.columns, "lines_dropped"]
    out = defaultdict(list)
    for r in got.collect():
        out[r.doc_id].append(r)
    assert "Follow us" not in out[0][0].text and out[0][0].lines_dropped == 1
    assert "Follow us" in out[52][0].text  # seldom on that site
    assert out[100][0].text == "exact copy\nbody"  # copies of a page count once
    assert out[200][0].text is None and out[201][0].text == "" and [r.text for r in out[202]] == ["", ""] and out[202][0].lines_dropped == 2
    assert linededup.drop_boilerplate(df.limit(0)).count() == 0


def test_boilerplate_joined_by_parts_of_a_host(spark, monkeypatch):
    rows = [(i, f"line {i}\nFollow us\n{'x' * (i % 3)}", "en", "hot" if i % 3 else None, 0) for i in range(120)] + [(200, None, "en", None, 0), (201, "Follow us", "en", "other", 0)] * 2
    df = spark.createDataFrame(rows, DOC).withColumn("salt", F.lit("s"))
    want = sorted(map(tuple, linededup.drop_boilerplate(df).collect()), key=repr)
    monkeypatch.setattr(linededup, "BROADCAST_LINES", -1)
    assert sorted(map(tuple, linededup.drop_boilerplate(df).collect()), key=repr) == want and sum(r[-1] for r in want) > 100


# ---- near duplicates -----------------------------------------------------------------------------
def brute_links(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = words.words(t)
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    links, label = Counter(), list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    return links, label


def near_texts():
    rnd = random.Random(10)
    base = prose(rnd, 120, 3000).split()
    texts = [prose(rnd, rnd.randint(3, 150), 3000) for _ in range(40)]
    for _ in range(90):
        w = list(base)
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = rnd.choice(["xx", "yy", "zz", "vv", "uu"])
        texts.append(" ".join(w))
    return [*texts, *texts[:5], texts[0].upper() + " !", "a b c", "a b c", "a", None, "", "...", None]


def test_links_and_classes_equal_brute_force(spark):
    texts = near_texts()
    links, label = brute_links(texts)
    got = {r.doc_id: r for r in ngramjoin.near_duplicates(docs_of(spark, texts, extra=True)).collect()}
    assert len(got) == len(texts)
    assert all(got[i].class_id == label[i] and got[i].n_links == links[i] for i in range(len(texts)))
    assert all(got[i].class_size == label.count(label[i]) for i in range(len(texts)))


def test_groups_of_many_blocks_and_sizes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", 8)
    rnd = random.Random(4)
    long = prose(rnd, 400, 5000).split()
    # prefixes of one text tie sizes together that are far apart; near_texts adds a group of equal sizes
    texts = [*(" ".join(long[: 30 + 5 * i]) for i in range(70)), *(" ".join(long[: 30 + 5 * i] + ["end"]) for i in range(70)), *near_texts()]
    links, label = brute_links(texts)
    assert label.count(label[0]) == 140
    got = {r.doc_id: r for r in ngramjoin.near_duplicates(docs_of(spark, texts)).collect()}
    assert [(got[i].class_id, got[i].n_links) for i in range(len(texts))] == [(label[i], links[i]) for i in range(len(texts))]


def test_a_group_of_several_blocks_at_the_shipped_sizes(spark):
    rnd = random.Random(6)
    base = prose(rnd, 110, 3000).split()
    texts = []
    for i in range(700):
        w = list(base)
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = rnd.choice(["xx", "yy", "zz", "vv", "uu"])
        texts.append(" ".join([*w, f"end{i}"]))
    links, label = brute_links(texts)
    assert len(set(texts)) == 700 > 2 * ngramjoin.BLOCK and set(label) == {0} and len(set(links.values())) > 50
    got = {r.doc_id: r for r in ngramjoin.near_duplicates(docs_of(spark, texts)).collect()}
    assert [(got[i].class_id, got[i].n_links, got[i].class_size) for i in range(700)] == [(0, links[i], 700) for i in range(700)]
    assert [r.doc_id for r in ngramjoin.keep_one(docs_of(spark, texts)).collect()] == [0]


def test_one_of_each_class_stays(spark):
    texts = near_texts()
    _, label = brute_links(texts)
    df = docs_of(spark, texts, extra=True)
    kept = ngramjoin.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
    # rows that repeat an id, or have none
    odd = spark.createDataFrame([(1, "p q r s t u v", "", "", 0)] * 3 + [(None, "k l m n o", "", "", 0)] * 2 + [(None, "other words are here now", "", "", 0), (2, None, "", "", 0), (2, None, "", "", 0)], DOC)
    assert Counter((r.doc_id, r.text) for r in ngramjoin.keep_one(odd).collect()) == Counter({(1, "p q r s t u v"): 1, (None, "k l m n o"): 1, (None, "other words are here now"): 1, (2, None): 2})
    assert ngramjoin.keep_one(docs_of(spark, [])).count() == 0


def test_bands_reach_the_recall():
    for t, recall in ((0.8, 0.9999), (0.5, 0.9)):
        b = ngramjoin.bands_for(t, recall)
        assert 1 - (1 - t**ngramjoin.ROWS) ** b >= recall > 1 - (1 - t**ngramjoin.ROWS) ** (b - 1)


@pytest.mark.parametrize("most", [400_000, 3, 0])
def test_components(spark, most):
    rnd = random.Random(11)
    for edges in ([(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(rnd.randrange(30), rnd.randrange(30)) for _ in range(20)], [(3, 3)]):
        part = {}
        for a, b in edges:
            if a != b:
                merged = part.get(a, {a}) | part.get(b, {b})
                part.update(dict.fromkeys(merged, merged))
        got = defaultdict(set)
        for r in connected_components(spark.createDataFrame(edges, "u long, v long"), most).collect():
            got[r.label].add(r.node)
        assert sorted(map(sorted, got.values())) == sorted(map(list, {tuple(sorted(s)) for s in part.values()}))


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_rows_by_key_are_the_same_sent_or_joined(spark, most):
    """Copies of a row, nulls, keys of equal halves and columns named like the key's."""
    digest = lambda i: hashlib.md5(str(i).encode()).digest()
    special = [digest(1)[:8] + x for x in (b"\0" * 8, b"\0" * 7 + b"\1", b"\xff" * 8)]
    known = [digest(i) for i in range(0, 60, 2)] + special[:2]
    rows = [(i, k, None if i % 5 else "t") for i, k in enumerate([digest(i) for i in range(60)] * 2 + special)]
    df = spark.createDataFrame(rows, "i int, k binary, key string").withColumn("KEY_", F.lit(1))
    keys = spark.createDataFrame([(k,) for k in known], "some binary")
    for keep in (True, False):
        got = rows_with_keys(df, F.col("k"), keys, keep, most)
        assert got.columns == df.columns
        assert Counter(r.i for r in got.collect()) == Counter(i for i, k, _ in rows if (bytes(k) in known) == keep)
    assert rows_with_keys(df, F.col("k"), keys.limit(0), False, most).count() == len(rows)
    assert rows_with_keys(df.limit(0), F.col("k"), keys, True, most).count() == 0


# ---- search --------------------------------------------------------------------------------------
def test_top_k_equals_all_scores(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.choice([-0.5, 0.0, 0.25, 0.5], 6)]) for i in range(300)]
    rows += [(300, None), (301, [0.1, None, 0.2]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (304, []), (305, [1.0, 1.0]), (306, rows[5][1]), (306, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"g": F.lit(1), "side": F.lit(2), "v": F.lit(3)})
    sound = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, v in {i: v for i, v in sound if i % 50 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q)[:5]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.filter("vec_id % 50 = 0")).collect()]
    assert set(got) == want and len(got) == len(want)
    few = df.filter("vec_id in (0, 1, 2)")
    assert topk.top_k(few, few.filter("vec_id = 0")).count() == 2
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("spread, least_skipped", [(0.02, 0.8), (3.0, 0.0)])
def test_blocks_below_the_kth_score_are_skipped(spark, spread, least_skipped):
    """Many blocks and groups: of rows in tight clusters most are never scored, and the answer is that of all scores."""
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(30, 8))
    v = np.repeat(centres, 40, axis=0) + spread * rng.normal(size=(1200, 8))
    v[100:400] = v[100]  # a quarter are copies
    df = spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(rng.permutation(1200), v)], "vec_id long, embedding array<double>")
    answer, alive, blocks = topk._searched(df, df.filter("vec_id % 50 = 0"), 5, "vec_id", "embedding", 256.0, 8, 160)
    whole = {r.vec_id: np.floor(256 * np.array(r.embedding)).astype(int) for r in df.collect()}
    want = {(q, n, i, -s) for q in whole if q % 50 == 0 for n, (s, i) in enumerate(sorted((-int(whole[q] @ w), i) for i, w in whole.items() if i != q)[:5], 1)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in answer.collect()} == want
    n_blocks, visits = blocks.count(), alive.filter("side = 1").agg(F.sum("width")).first()[0] or 0
    assert n_blocks >= 150 and blocks.select("g").distinct().count() >= 8
    assert visits <= (1 - least_skipped) * n_blocks * 24


def test_huge_components_stay_exact(spark):
    v = {i: [2_000_000_011, b, -1] for i, b in enumerate((1, 2, 3, 3, 2, 9, 8))}
    df = spark.createDataFrame([(i, [x / 256 for x in e]) for i, e in v.items()], "vec_id long, embedding array<double>")
    want = sorted((-sum(a * b for a, b in zip(v[0], v[i])), i) for i in v if i)[:5]
    got = [(-r.score, r.vec_id) for r in topk.top_k(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == want and -got[0][0] > 2**53
    far = spark.createDataFrame([(i, [float(2.0**e)]) for i, e in enumerate((30, 32, 33))], "vec_id long, embedding array<double>")
    got = topk.top_k(far, far.filter("vec_id = 0")).orderBy("rank").collect()  # 2^78 and 2^79: ranked as they are, shown as the longs' end
    assert [(r.vec_id, r.score) for r in got] == [(2, 2**63 - 1), (1, 2**63 - 1)]


# ---- quality and language ------------------------------------------------------------------------
def test_quality_shrinks_sparse_sites(spark):
    rnd = random.Random(13)
    rows, labels = [], []
    for i in range(600):
        site = "good" if i % 3 == 0 else "bad" if i % 3 == 1 else f"rare{i}"
        y = int(rnd.random() < {"good": 0.95, "bad": 0.2}.get(site, 0.6))
        rows.append((i, prose(rnd, 20), "en" if i % 2 else None, site, 0))
        labels.append((i, y))
    rows += [(1000, None, None, None, 0), (1001, "", "en", "good", 0), (1001, "", "en", "good", 0), (None, "x", "en", "bad", 0)]
    df = spark.createDataFrame(rows, DOC).withColumns({"host": F.lit(0), "path": F.lit(0), "x": F.lit(0), "hp": F.lit(0), "n": F.lit(0)})
    got = quality.score_quality(df, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int"))
    out = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows) and all(0 <= r.score <= 1 for r in out.values())
    assert out[0].host_posterior > 0.85 > 0.35 > out[1].host_posterior
    assert abs(out[2].host_posterior - 0.6) < 0.35  # one label moves a site little
    assert quality.score_quality(df, spark.createDataFrame([], "doc_id long, quality int")).filter("abs(score - 0.5) > 1e-9").count() == 0
    assert quality.score_quality(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_quality_equals_a_plain_rerun(spark):
    """The whole operator once more in plain Python: sample, classifier, moments, posteriors and scores; odd rows included."""
    rnd = random.Random(19)
    rows = [(i, prose(rnd, rnd.randint(0, 60)), rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "c", f"rare{i}", None]), 0) for i in range(300)]
    rows += [(300, None, None, None, None), (301, "x " * 100_000, "en", "a", 0), rows[5], rows[5], (None, "y", "en", "b", 0)]
    labels = [(i, int(rnd.random() < (0.8 if rows[i][3] == "a" else 0.4))) for i in range(300)] + [(3, 1), (None, 1), (9, None)]
    got = quality.score_quality(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    y = {}
    for i, v in labels:
        if i is not None and v is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            y[i] = max(v, y.get(i, 0))
    taught = [(i, tuple(quality.features(t or "")), h, p, y[i]) for i, t, p, h, _ in rows if i in y]
    prior = (sum(r[4] for r in taught) + 0.5) / (len(taught) + 1)
    sample = sorted({(r[0], r[1], r[4]) for r in taught})
    share = np.mean([v for _, _, v in sample])
    mean, scale, w = quality.fit_logistic(np.array([x for _, x, _ in sample]), np.array([v for _, _, v in sample], dtype=float))
    w[-1] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))

    def strength(groups):
        a = b = 0.0
        groups = [g for g in groups if g[0] >= 2]
        for n, k, p in groups:
            p = min(max(p, 1e-3), 1 - 1e-3)
            a += (n - 1) * ((k / n - p) ** 2 / (p * (1 - p)) - 1 / n)
            b += (n - 1) * (1 - 1 / n)
        rho = a / max(1e-9, b)
        return 1000.0 if len(groups) < 2 or rho <= 1 / 1001 else min(max(1 / rho - 1, 1.0), 1000.0)

    hosts, paths = defaultdict(list), defaultdict(list)
    for _, _, h, p, v in taught:
        hosts[h].append(v)
        paths[h, p].append(v)
    m = strength([(len(v), sum(v), prior) for v in hosts.values()])
    host_p = {h: (sum(v) + m * prior) / (len(v) + m) for h, v in hosts.items()}
    m = strength([(len(v), sum(v), host_p[h]) for (h, _), v in paths.items()])
    path_p = {hp: (sum(v) + m * host_p[hp[0]]) / (len(v) + m) for hp, v in paths.items()}
    want = Counter()
    for i, t, p, h, _ in rows:
        x = quality._expand((np.array([quality.features(t or "")]) - mean) / scale) @ w
        text_p = min(max(1 / (1 + np.exp(-np.clip(x[0], -40, 40))), 1e-9), 1 - 1e-9)
        of_host = host_p.get(h, prior)
        of_path = path_p.get((h, p), of_host)
        logit = np.log(text_p / (1 - text_p)) + np.log(of_path / (1 - of_path)) - np.log(prior / (1 - prior))
        want[i, round(1 / (1 + np.exp(-logit)), 5), round(of_host, 6), round(of_path, 6)] += 1
    assert Counter((r.doc_id, round(r.score, 5), round(r.host_posterior, 6), round(r.path_posterior, 6)) for r in got) == want


def test_a_language_of_long_texts_alone_is_learnt(spark):
    """Whole long texts train too; repeated rows, extra columns, ties and very long texts each have their answer."""
    rnd = random.Random(5)
    german = "der die das und nicht mit einer haus straße über schön werden können immer zwischen".split()
    english = "the and not with house street over lovely become could always between which there would".split()
    rows = [(i, " ".join(rnd.choices(german, k=5000)), "de", "s", 0) for i in range(40)]
    rows += [(i, " ".join(rnd.choices(english, k=20)), "en", "s", 0) for i in range(40, 80)]
    rows += [rows[0], rows[0], (None, rows[1][1], "de", "s", 0), (99, "das haus " * 200_000, None, None, None)]
    df = spark.createDataFrame(rows, DOC).withColumns({"place": F.lit(0), "value": F.lit("x"), "score": F.lit(0), "lang_pred": F.lit(1)})
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.lang_pred == ("de" if r.doc_id is None or r.doc_id < 40 or r.doc_id == 99 else "en")


def test_languages_equal_a_plain_rerun(spark):
    """The whole operator once more without Spark: the same sample, machines, votes and scores."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    known = [(i, t, x) for i, t, x in rows if t and x and re.search(r"[^\W\d_]", t) and zlib.crc32(str(i).encode()) % 4 != 2]
    assert max(Counter(x for _, _, x in known).values()) <= langid.SAMPLE_PER_LANGUAGE  # so that all of them are the sample
    own = sorted({(x, langid.vectors([t])[0].tobytes()) for _, t, x in known})
    x, y = np.stack([np.frombuffer(v, np.float32) for _, v in own]), np.array([n for n, _ in own])
    families = sorted({langid.family_of(n) for n in y})
    of = np.array([langid.family_of(n) for n in y])
    machines = {f: langid.fit_svm(x, np.where(of == f, 1.0, -1.0)) for f in families}
    want = {}
    for i, t, _ in rows:
        v = langid.vectors([t or ""])[0]
        margin = {f: float(v @ w + b) for f, (w, b) in machines.items()}
        family = max(families, key=lambda f: margin[f])
        langs = sorted({n for n in y if langid.family_of(n) == family})
        votes = Counter()
        for a, b in itertools.combinations(langs, 2):
            keep = (y == a) | (y == b)
            w, c = langid.fit_svm(x[keep], np.where(y[keep] == a, 1.0, -1.0))
            votes[a if v @ w + c >= 0 else b] += 1
        top = [n for n in langs if votes[n] == max(votes.values(), default=0)]
        want[i] = top if re.search(r"[^\W\d_]", t or "") else ["und"]
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert all(got[i] in want[i] for i in want) and len(got) == len(want)


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en", "", 0), (-2, "", "en", "", 0), (-3, "123 !?", None, "", 0), (-4, "é", None, "", 0)], DOC)
    got = {r.doc_id: r for r in langid.identify(docs.unionByName(odd)).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.98 * len(held)
    assert [got[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and got[-4].lang_pred in set(truth.values())
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.filter("doc_id = -4")).collect()} == {"und"}
