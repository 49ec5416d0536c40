"""The pipeline's stages in order, and the registered queries against DuckDB."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from slabwise.llm import decontam, toxicity
from slabwise.llm.common import table
from slabwise.llm.queries import ORACLES, QUERIES

from .test_operators import brute_links

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    entry.ship(spark)
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert out.columns == columns
        after = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "toxicity":
            scores = toxicity.score_toxicity(docs, table(spark, DATA, "labels")).collect()
            assert after == {r.doc_id for r in scores if r.score < 0.3}
        elif name == "line_dedup":
            assert after == set(before) and out.filter("n_chars <> length(text)").count() == 0
        elif name == "ngram_jaccard_join":
            rows = sorted(before.values(), key=lambda r: r.doc_id)
            assert after == {rows[i].doc_id for i in brute_links([r.text for r in rows])[1]}
        elif name == "benchmark_decontamination":
            assert after == set(before) - {r.doc_id for r in decontam.find_leaks(docs, table(spark, DATA, "benchmark")).collect()}
        else:
            assert after == set(before)
        docs = out
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    df = entry.queries()[name](spark, DATA)
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert sorted(df.columns) == sorted(names)
    assert key(df.select(*names).collect()) == key(cur.fetchall())


def test_thirteen_queries():
    assert {f"op{n}_" for n in range(1, 13)} == {f"{q.split('_')[0]}_" for q in QUERIES}
    assert "pipeline" in entry.queries()


ODD = ("id", "key", "__key", "KEY_", "tkey", "row", "lines_dropped", "text_", "y", "score", "part", "length", "salt", "node", "label", "copies")


def odd_documents(spark):
    long = " ".join(f"w{i % 977} x{i}" for i in range(150_000))
    rows = [(0, "one two three four five six seven", "en", "s", 7), (1, None, None, None, None), (2, "", "en", "s", 0), (3, " ... ", "en", None, 5), (None, "a b c d e f g h i", None, "s", None)]
    rows += [(4, long, "en", "s", 1), (5, long + " tail", "en", "s", 1), rows[0], (6, rows[0][1], "en", "t", 7), (4, "another text of the same id here", "en", "s", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ODD:
        df = df.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return df


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_columns(spark, name, stage):
    docs = odd_documents(spark)
    out = stage(spark, docs, DATA)
    rows = Counter((r.doc_id, r.text if name != "best_fit_packing" else r.piece) for r in out.collect())
    given = Counter((r.doc_id, r.text) for r in docs.collect())
    if name == "best_fit_packing":
        whole = Counter(i for i, _ in given.elements())
        assert all(rows[i, 0] == n for i, n in whole.items())
    else:
        assert out.columns == docs.columns and out.filter("id <> concat('id', coalesce(cast(doc_id as string), '-'))").count() == 0
        lost = given - rows
        if name == "ngram_jaccard_join":  # the repeated row, the copy under another id, and the near copy of the long text
            assert sorted((i, len(t)) for i, t in lost.elements()) == [(0, 33), (5, max(len(t or "") for _, t in given)), (6, 33)]
        else:
            assert not lost
    empty = stage(spark, docs.limit(0), DATA)
    assert empty.count() == 0 and (name == "best_fit_packing" or empty.columns == docs.columns)
