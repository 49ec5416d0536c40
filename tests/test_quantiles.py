"""Exact selection from brackets, against numpy."""

import numpy as np
import pytest

from slabwise.operators import ranking

SHARES = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]


def check(spark, groups, shares=SHARES):
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g int, v double").repartition(7)
    got = {(r.g, r.share): r["quantile"] for r in ranking.quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == {(g, s) for g, vs in groups.items() if len(vs) for s in shares}
    for (g, s), q in got.items():
        want = np.quantile(np.asarray(groups[g], dtype=float), s)
        assert abs(q - want) <= 1e-12 * max(1.0, abs(want)), (g, s, q, want)


@pytest.fixture
def narrow(monkeypatch):
    monkeypatch.setattr(ranking, "LAST", 20)


def test_many_rounds_of_narrowing(spark, narrow):
    rng = np.random.default_rng(0)
    check(spark, {1: rng.normal(size=20_000), 2: np.exp(rng.normal(0, 20, 3000)), 3: rng.random(25), 4: [5.0], None: rng.normal(size=500)})


def test_a_value_that_holds_a_third_and_two_that_hold_all(spark, narrow):
    rng = np.random.default_rng(1)
    third = np.where(rng.random(6000) < 0.33, 0.25, rng.random(6000))
    check(spark, {1: third, 2: [1.0] * 1000 + [2.0] * 1000, 3: [7.0] * 3000, 4: [1.0] * 999 + [2.0] * 1001})


def test_a_sketch_that_errs_changes_nothing(spark, narrow, monkeypatch):
    """Borders off by a fifth of the places: counts find the places missed."""
    real = ranking._sketch
    monkeypatch.setattr(ranking, "_sketch", lambda v, k: real(v, k).withColumn("steps", ranking.F.concat(ranking.F.slice("steps", 201, 801), ranking.F.array_repeat(ranking.F.element_at("steps", 1001), 200))))
    rng = np.random.default_rng(2)
    check(spark, {1: rng.normal(size=5000), 2: rng.normal(size=300)})


def test_nan_null_infinite_and_empty(spark):
    df = spark.createDataFrame([(1, 1.0), (1, float("nan")), (1, None), (1, 3.0), (2, float("inf")), (2, 0.0), (2, float("inf")), (3, None)], "g int, v double")
    got = {(r.g, r.share): r["quantile"] for r in ranking.quantiles(df, ["g"], "v", [0.0, 0.5, 1.0]).collect()}
    assert got[1, 0.0] == 1.0 and got[1, 0.5] == 3.0 and np.isnan(got[1, 1.0])
    assert got[2, 0.0] == 0.0 and got[2, 0.5] == got[2, 1.0] == float("inf") and (3, 0.5) not in got
    assert ranking.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_only_brackets_are_shuffled(spark, monkeypatch):
    """Of 200,000 values the last exchange has those of the bracket, and no plan sorts the table."""
    seen = []
    real = ranking._Bracket.counted
    monkeypatch.setattr(ranking, "LAST", 2000)
    monkeypatch.setattr(ranking._Bracket, "counted", lambda self, below, inside: (seen.append(inside), real(self, below, inside)))
    df = spark.range(200_000).selectExpr("cast(id % 2 as int) as c", "rand(3) as v")
    got = ranking.quantiles(df, ["c"], "v", [0.5])
    assert got.count() == 2 and max(seen) < 0.02 * 100_000
    assert "rangepartitioning" not in got._jdf.queryExecution().toString()
