"""Every registered query with an oracle equals DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from slabwise.plans import load_catalog

DATA = "/root/testdata/sf0.001"
CATALOG = load_catalog()
# a few quick ones of each kind; the rest is compared by the driver at sf0.01
NAMES = [
    "split_slices", "slice_infos", "scaled_3d", "knn_intra", "radius_inter", "expr_knn_map", "mutual_knn", "cost_clip_cap", "sinkhorn_steps", "procrustes_similarity",
    "chamfer", "held_karp", "gene_filter", "bh_adjust", "sparkx_statistic", "nmi", "silhouette", "label_codes", "mtx_roundtrip", "gmm_m_step",
]


def rows(records, names):
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6)
        return v

    return sorted((tuple(plain(dict(zip(names, r))[n]) for n in sorted(names)) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_oracle(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(CATALOG.ORACLES[name])
    assert got == rows(cur.fetchall(), [d[0] for d in cur.description])


def test_entry(spark):
    assert entry.entry(spark).columns == ["src", "dst", "w"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
