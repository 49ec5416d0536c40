"""Personal data: patterns, and terms that reveal it by co-occurrence.

Patterns find the protected entities (an email address, IP address, card or phone
number, each by its value and as one of its kind). Corpus statistics then tell how strongly a word in the same text reveals it:
the pointwise mutual information of word and entity, as a share of the entity's own
information. A word that gives away most of it is generalised, one that gives away
nearly all of it is removed, wherever it stands in a text that holds the entity.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, slices

#: Kinds of spans in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone", "general", "remove")

#: Shares of an entity's information from which a word is generalised or removed, and different texts that must show word and entity together.
GENERALISE, REMOVE, LEAST_TEXTS = 0.8, 0.95, 3

#: Candidate words that are sent to every task when document frequencies are counted; beyond, all words' counts are shuffled instead.
BROADCAST_TERMS = 500_000

#: Words whose counts a task holds before it hands them on.
HELD_TERMS = 200_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is entered at its start only, and never given back: the leftmost matches are the same, in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile(r"\w+")


def _emails(text: str):
    """The matches of local@domain: for each @ the run of local characters before it, no farther back than the last match."""
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            end = m.end()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, entity) by start and kind; kind is a place in KINDS, entity the normalised value."""
    out = []
    if "@" in text:
        out += [(a, 0, b, text[a:b].lower()) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end(), m.group()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 9 <= len(digits) <= 15:
                out.append((m.start(), 3, m.end(), digits))
    return sorted(out)


def loose_terms(text: str, spans: list[tuple[int, int, int, str]]):
    """(word, start, end) of the words that lie outside all spans; these are sorted by start."""
    k = reach = 0
    for m in _TERM.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][2])
            k += 1
        if reach <= m.start():
            yield m.group().lower(), m.start(), m.end()


def _found(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "tkey", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "base", "entities", "held"]
    base_kind = pa.list_(pa.struct([("s", pa.int64()), ("k", pa.int32()), ("e", pa.int64())]))

    def find(batches):
        for batch in batches:
            rows = []
            for x in batch.column("text"):
                text = x.as_py() or ""
                spans = base_spans(text)
                count = Counter(k for _, k, _, _ in spans)
                listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)
                entity = [f"{KINDS[k]}:{v}" for _, k, _, v in spans]
                entity += [KINDS[k] for _, k, _, _ in spans]
                rows.append((*(count[k] for k in range(4)), hashlib.sha256(listed.encode()).hexdigest(), [{"s": a, "k": k, "e": b} for a, k, b, _ in spans], sorted(set(entity)), text if spans else None))
            kinds = [*[pa.int64()] * 4, pa.string(), base_kind, pa.list_(pa.string()), pa.string()]
            cols = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tkey"), *cols], names=names)

    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("tkey"), text.alias("text")).mapInArrow(
        find,
        f"`{id_col}` {id_type}, tkey binary, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
        "base array<struct<s: long, k: int, e: long>>, entities array<string>, held string",
    )


def document_frequencies(docs: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """(term, n): documents that hold each of the terms, over all rows and whole texts."""
    spark = docs.sparkSession
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    wanted = spark.sparkContext.broadcast(frozenset(r["term"] for r in terms.collect())) if few else None

    def count(batches):
        held: Counter = Counter()
        only = wanted.value if wanted else None

        def hand_on():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for x in batch.column("text"):
                own = {w.lower() for w in _TERM.findall(x.as_py() or "")}
                held.update(own if only is None else own & only)
                if len(held) > HELD_TERMS:
                    yield hand_on()
                    held.clear()
        yield hand_on()

    if few and not terms.limit(1).count():
        return spark.createDataFrame([], "term string, n long")
    counted = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "term string, n long")
    counted = counted.groupBy("term").agg(F.sum("n").alias("n"))
    return counted if few else counted.join(terms, "term", "left_semi")


def _spans(row: dict) -> list[tuple[int, int, int, str]]:
    return [(x["s"], x["k"], x["e"], "") for x in row["base"]]


def _pairs(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, term, both, texts): documents and different texts that hold both, summed up in the tasks. A null entity: documents that show the term inside entities alone."""
    spark = texts.sparkSession
    few = entities.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    wanted = spark.sparkContext.broadcast(frozenset(r["entity"] for r in entities.select("entity").collect())) if few else None

    def count(batches):
        both: Counter = Counter()
        different: Counter = Counter()

        def hand_on():
            keys = list(both)
            cols = [pa.array([e for e, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.string()), pa.array([both[k] for k in keys], pa.int64()), pa.array([different[k] for k in keys], pa.int64())]
            both.clear()
            different.clear()
            return pa.RecordBatch.from_arrays(cols, names=["entity", "term", "both", "texts"])

        for batch in slices(batches, 64):
            for row in batch.to_pylist():
                own = {w for w, _, _ in loose_terms(row["held"], _spans(row))}
                hidden = {w.lower() for w in _TERM.findall(row["held"])} - own
                for e, terms in [(None, hidden), *((e, own) for e in row["entities"] if wanted is None or e in wanted.value)]:
                    keys = [(e, t) for t in terms]
                    different.update(keys)
                    for k in keys:
                        both[k] += row["copies"]
                    if len(both) > HELD_TERMS:
                        yield hand_on()
        yield hand_on()

    counted = texts.select("copies", "entities", "base", "held").mapInArrow(count, "entity string, term string, both long, texts long")
    return counted.groupBy("entity", "term").agg(F.sum("both").alias("both"), F.sum("texts").alias("texts"))


def _places(texts: DataFrame, revealing: DataFrame) -> DataFrame:
    """(tkey, terms array<(s, k, e)>): where a text shows the terms that reveal one of its entities."""
    spark = texts.sparkSession
    if revealing.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        known: dict[str, dict[str, int]] = {}
        for r in revealing.collect():
            known.setdefault(r["entity"], {})[r["term"]] = r["k"]
        shared = spark.sparkContext.broadcast(known)
        texts = texts.select("tkey", "entities", "base", "held", F.lit(None).cast("array<struct<term: string, k: int>>").alias("wanted"))
    else:
        shared = None

        def triples(batches):
            for batch in slices(batches, 64):
                for row in batch.to_pylist():
                    terms = sorted({w for w, _, _ in loose_terms(row["held"], _spans(row))})
                    for e in row["entities"]:
                        n = len(terms)
                        yield pa.RecordBatch.from_arrays([pa.array([row["tkey"]] * n, pa.binary()), pa.array([e] * n, pa.string()), pa.array(terms, pa.string())], names=["tkey", "entity", "term"])

        met = texts.select("tkey", "entities", "base", "held").mapInArrow(triples, "tkey binary, entity string, term string").join(revealing, ["entity", "term"])
        wanted = met.groupBy("tkey", "term").agg(F.max("k").alias("k")).groupBy("tkey").agg(F.collect_list(F.struct("term", "k")).alias("wanted"))
        texts = texts.select("tkey", "entities", "base", "held").join(wanted, "tkey")

    def mark(batches):
        kind = pa.list_(pa.struct([("s", pa.int64()), ("k", pa.int32()), ("e", pa.int64())]))
        for batch in slices(batches, 64):
            keys, out = [], []
            for row in batch.to_pylist():
                wanted = {x["term"]: x["k"] for x in row["wanted"] or ()}
                found = []
                own = [shared.value[e] for e in row["entities"] if e in shared.value] if shared else [wanted]
                for w, a, b in loose_terms(row["held"], _spans(row)) if own else ():
                    k = max((terms.get(w, -1) for terms in own), default=-1)
                    if k >= 0:
                        found.append({"s": a, "k": k, "e": b})
                if found:
                    keys.append(row["tkey"])
                    out.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, kind)], names=["tkey", "terms"])

    return texts.mapInArrow(mark, "tkey binary, terms array<struct<s: long, k: int, e: long>>")


def _reveal(docs: DataFrame, found: DataFrame, text_col: str, generalise: float, remove: float, least_texts: int) -> DataFrame:
    """(tkey, terms array<(s, k, e)>): the words to be generalised or removed in each text that has any.

    Only texts with entities are looked at word by word, and of their entities those that `least_texts` texts hold.
    """
    first = [F.first(c).alias(c) for c in ("entities", "base", "held")]
    texts = cut(found.filter(F.size("entities") > 0).groupBy("tkey").agg(F.count("*").alias("copies"), *first))
    entities = texts.select("copies", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("in_texts"))
    entities = cut(entities.filter(F.col("in_texts") >= least_texts).select("entity", "n_entity"))
    counted = cut(_pairs(texts, entities).filter(F.col("entity").isNull() | (F.col("texts") >= least_texts)))
    pairs = counted.filter("entity is not null")
    total = found.count()
    # what stands inside entities alone is no word of its document
    hidden = counted.filter("entity is null").select("term", F.col("both").alias("inside"))
    frequency = document_frequencies(docs, text_col, pairs.select("term").distinct()).join(hidden, "term", "left")
    frequency = frequency.select("term", (F.col("n") - F.coalesce("inside", F.lit(0))).alias("n"))
    own = F.log(F.lit(float(total)) / F.col("n_entity"))
    shared = F.log(F.lit(float(total)) * F.col("both") / (F.col("n_entity") * F.col("n")))
    # the kinds themselves, four rows, hold a large share of pairs
    of_kind = F.col("entity").isin(*KINDS[:4])
    met = pairs.filter(~of_kind).join(entities.filter(~of_kind), "entity").unionByName(pairs.filter(of_kind).join(F.broadcast(entities.filter(of_kind)), "entity"))
    scored = met.join(frequency, "term").withColumn("share", F.when(own > 0, shared / own))
    revealing = scored.filter(F.col("share") >= generalise).select(
        "entity", "term", F.when(F.col("share") >= remove, KINDS.index("remove")).otherwise(KINDS.index("general")).alias("k")
    )
    return _places(texts, cut(revealing))


def find_personal(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    generalise: float = GENERALISE,
    remove: float = REMOVE,
    least_texts: int = LEAST_TEXTS,
) -> DataFrame:
    """Spans of personal data and of the words that reveal it, in every whole text.

    Base spans: email, ip, card and phone by their patterns, leftmost and without
    overlap within a kind; matches that fail a check are dropped. All places of a word
    (letters, digits and underscores, outside base spans) in a text with an entity are
    `general` or `remove` spans where log(N n_both / (n_entity n_word)) / log(N / n_entity)
    reaches `generalise` or `remove`; n counts whole documents, and `least_texts` different
    texts must show both together, so copies of one text prove nothing. An entity in every document has no information
    and reveals no words. A null text is empty. Repeated rows and null ids are answered
    each; an empty table gives no rows.

    Returns (id_col, tkey, n_email, n_ip, n_card, n_phone, base_sha256, spans): spans is
    an array of (s, k, e), start, place in KINDS and end in code points, end exclusive.
    """
    found = cut(_found(docs, text_col, id_col))
    terms = cut(_reveal(docs, found, text_col, generalise, remove, least_texts))
    whole = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "terms")))
    return found.join(terms, "tkey", "left").select(id_col, "tkey", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", whole.alias("spans"))


def listed(spans):
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def sanitise(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """docs with text_col rewritten: entities become [EMAIL], [IP], [CARD] or [PHONE], revealing words [WORD] or nothing.

    Of spans that overlap, the one that starts first (then by kind) is rewritten. A
    null text stays null. The columns of docs are returned.
    """
    key, tkey, spans = (fresh(docs.columns, x) for x in ("key", "tkey", "spans"))
    by_text = find_personal(docs, text_col, id_col, **options).filter(F.size("spans") > 0).select(F.col("tkey").alias(tkey), F.col("spans").alias(spans)).dropDuplicates([tkey])
    digest = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")))
    joined = docs.withColumn(key, digest).join(by_text, F.col(key) == F.col(tkey), "left")

    @F.pandas_udf("string")
    def rewrite(texts, spans):
        import pandas as pd

        says = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[WORD]", "")
        out = []
        for text, own in zip(texts, spans):
            if text is None or own is None or not len(own):
                out.append(text)
                continue
            parts, at = [], 0
            for x in own:
                if x["s"] >= at:
                    parts += [text[at : x["s"]], says[x["k"]]]
                    at = x["e"]
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    new = F.when(F.col(spans).isNull(), F.col(f"`{text_col}`")).otherwise(rewrite(F.col(f"`{text_col}`"), F.col(spans)))
    return joined.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
