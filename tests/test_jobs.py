"""The jobs: runs that are repeated, cut short or fed more, odd rows, command lines, and their queries against DuckDB."""

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from jobs import neighbourhood_atlas, queries, word_profiles
from jobs.common import load_config, watched

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
LOOSE = {"least_units": 1, "least_total": 1, "least_slices": 1}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_equal_their_oracles(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert key(df.select(*names).collect()) == key(cur.fetchall())


# ---- the incremental job -------------------------------------------------------------------------
TEXTS = "doc_id long, text string, source string"


def add(spark, path, rows):
    spark.createDataFrame(rows, TEXTS).coalesce(1).write.mode("append").parquet(path)


def plain(rows, top=100):
    """{(slice, feature): (n_units, total)} by hand."""
    out = {}
    for _, text, source in rows:
        w = (text or "").lower().split()
        for x in set(w):
            n, t = out.get((source or "nan", x), (0, 0))
            out[source or "nan", x] = (n + 1, t + w.count(x))
    return out


def profiles(spark, path):
    return {(r.slice, r.feature): (r.n_units, r.total) for r in word_profiles.result(spark, path).collect()}


FIRST = [(1, "a b a", "s"), (2, "a C", "s"), (3, None, "s"), (4, "", None), (5, "b", None)]
SECOND = [(6, "a a d", "s"), (1, "a b a", "s"), (7, "d", "t/u=1 x"), (8, " ".join(["w"] * 40_000 + ["v"]), "t/u=1 x")]


def test_a_growing_input_is_counted_once(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("in", "out", "state")]
    add(spark, paths[0], FIRST)
    assert word_profiles.run(spark, *paths, LOOSE)["read"] == 5
    assert profiles(spark, paths[1]) == plain(FIRST)
    assert word_profiles.run(spark, *paths, LOOSE)["read"] == 0
    add(spark, paths[0], SECOND)
    done = word_profiles.run(spark, *paths, LOOSE)
    assert done["read"] == len(SECOND) and done["batches"] == 1 and done["slices"] == 3
    assert profiles(spark, paths[1]) == plain(FIRST + SECOND)
    once = [str(tmp_path / x) for x in ("in", "out2", "state2")]
    word_profiles.run(spark, *once, LOOSE | {"files_per_batch": 1})
    assert profiles(spark, once[1]) == profiles(spark, paths[1])


def test_a_batch_that_was_cut_short_is_taken_again(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("in", "out", "state")]
    add(spark, paths[0], FIRST)
    word_profiles.run(spark, *paths, LOOSE)
    add(spark, paths[0], SECOND)
    word_profiles.run(spark, *paths, LOOSE)
    for f in ("1", ".1.crc"):  # as if the second batch had been written, but not yet committed
        (tmp_path / "state" / "commits" / f).unlink(missing_ok=True)
    assert word_profiles.run(spark, *paths, LOOSE)["read"] == len(SECOND)
    assert profiles(spark, paths[1]) == plain(FIRST + SECOND)


def test_filters_places_and_odd_input(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("in", "out", "state")]
    rows = [(i, f"x y{i} {'x' * (i % 2)} httpz", "s") for i in range(12)] + [(i, "x x", "t") for i in range(6)] + [(20, "x", "")]
    df = spark.createDataFrame(rows, TEXTS).withColumns({"slice": F.lit(1), "feature": F.lit("q"), "batch": F.lit(2.5)})
    df.write.parquet(paths[0])
    word_profiles.run(spark, *paths, {"top": 1})
    got = {(r.slice, r.feature): (r.n_units, r.total, r.n_slices, r.place) for r in word_profiles.result(spark, paths[1]).collect()}
    assert got == {("s", "x"): (12, 18, 2, 1), ("t", "x"): (6, 12, 2, 1)}
    word_profiles.run(spark, paths[0], str(tmp_path / "out2"), str(tmp_path / "state2"), LOOSE)
    assert ("", "x") in profiles(spark, str(tmp_path / "out2"))
    empty = [str(tmp_path / x) for x in ("none", "out3", "state3")]
    spark.createDataFrame([], TEXTS).write.parquet(empty[0])
    assert word_profiles.run(spark, *empty)["profiles"] == 0 and word_profiles.result(spark, empty[1]).count() == 0


def test_watched_paths():
    assert watched("/a/b.parquet") == "/a/b.parque[t]" and watched("s://a/b/") == "s://a/[b]" and watched("/a/*.parquet") == "/a/*.parquet"


# ---- the batch job -------------------------------------------------------------------------------
def test_atlas_of_odd_rows_and_a_refreshed_slice(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, i % 4, [float(i % 7), float(i % 5) + i / 100]) for i in range(80)]
    odd = [(None, 1, [0.0, 0.0]), (100, None, [0.0, 0.0]), (101, 1, None), (102, 1, [1.0]), (103, 1, [float("nan"), 0.0]), (104, 2, [float("inf"), 0.0]), rows[0]]
    spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>").write.parquet(source)
    config = {"n_intra": 3, "n_inter": 2}
    done = neighbourhood_atlas.run(spark, source, out, config)
    assert done["read"] == 87 and done["spots"] == 80 and done["slices"] == 4
    spots, edges = (lambda: sorted(map(tuple, neighbourhood_atlas.result(spark, out).collect()))), (lambda: spark.read.parquet(f"{out}/edges"))
    first, first_edges = spots(), sorted(map(tuple, edges().collect()))
    n = {r.src: r["count"] for r in edges().groupBy("src").count().collect()}
    assert {r[0]: r[4] for r in first} == n and edges().filter("src = dst").count() == 0
    assert all(abs(r.w - r.back) < 1e-12 for r in edges().alias("a").join(edges().alias("b"), F.expr("a.src = b.dst and a.dst = b.src")).selectExpr("a.w", "b.w as back").collect())
    again = neighbourhood_atlas.run(spark, source, out, config | {"slices": [2]})  # one slice anew: all stands as before
    assert again["slices"] == 1 and again["spots"] == 20
    assert spots() == first and sorted(map(tuple, edges().collect())) == first_edges
    report = [json.loads(x) for f in Path(f"{out}/report").rglob("*.json") for x in f.read_text().splitlines()]
    assert sorted((r["slice"], r["spots"]) for r in report) == [(0, 20), (1, 20), (2, 20), (3, 20)] and sum(r["edges"] for r in report) == edges().count()


def test_command_lines(tmp_path):
    config = tmp_path / "c.json"
    config.write_text(json.dumps(LOOSE | {"slices": [3]}))
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    for job, table, extra in (("word_profiles", "documents", ["--checkpoint", str(tmp_path / "state")]), ("neighbourhood_atlas", "embeddings", [])):
        out = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--input", f"{DATA}/{table}.parquet", "--output", str(tmp_path / job), "--config", str(config), *extra], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
        assert out.returncode == 0 and f"{job}: read" in out.stderr and f"{job}: wrote" in out.stderr, out.stderr[-2000:]
    assert [p.name for p in (tmp_path / "neighbourhood_atlas" / "spots").glob("slice_idx=*")] == ["slice_idx=3"]
    assert len(list((tmp_path / "word_profiles" / "profiles").glob("slice=*"))) > 2
    assert load_config("word_profiles", str(config))["top"] == 100


def test_jobs_stand_without_the_optional_parts():
    code = "import sys, jobs.queries; assert not [m for m in sys.modules if m.startswith('slabwise.llm') or m == 'corpus_pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
