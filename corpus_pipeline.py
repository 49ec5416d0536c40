"""A corpus pipeline of five of the operators in slabwise.llm.

Every stage works on all documents that the one before kept. A stage takes
(spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next one's docs; the last returns packed pieces, the others the columns of docs.

All stages take nulls in any column, empty and very long texts, ties, repeated rows,
empty tables and extra columns of any name, which pass through. What each makes of
them stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slabwise.llm import decontam, linededup, ngramjoin, packing, toxicity
from slabwise.llm.common import cut, table
from slabwise.session import ship


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field scores 0.3 or more go.

    A null text is scored as an empty one and stays; repeated rows are judged each and
    alike; without documents, or without toxic labels, all rows there are stay.
    """
    ship(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate within their source are cut out of the texts; all documents stay.

    A null text stays null and an empty one empty; a null source is a site of its own;
    repeated rows are one page of their site and are cut alike. Where docs has n_chars, it
    is the new text's length, null for a null text.
    """
    kept = linededup.drop_boilerplate(docs, counted=False)
    return kept.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id stays, of equal ids the one of least text digest.

    Null, empty and wordless texts are no duplicates of anything and stay; of rows that
    repeat both id and text one stays; a null id comes after all others.
    """
    ship(spark)
    return ngramjoin.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with up to a fifth of its words edited, go.

    Null, empty and wordless texts hold none and stay; repeated rows are judged each and
    alike; without items all rows stay.
    """
    ship(spark)
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 1024 tokens.

    A null or empty text is its end id alone; repeated rows and null ids are packed
    each; texts of more than 1024 tokens are cut; no documents give no rows.
    """
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_jaccard_join", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]

#: Scores, MinHash bands and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows kept in the shared checkpoint folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
