"""Training by gradients that are summed from tasks."""

import numpy as np
import pytest

from slabwise.model import ContrastiveConfig
from slabwise.operators import contrastive

CONFIG = ContrastiveConfig(epochs=20, embed_dim=4, hidden_dim=8, batch_size=12, parallel=3, lr=1e-2)


def graph(spark, n=50, d=6):
    rng = np.random.default_rng(0)
    x = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, d)))], "gid long, vec array<double>")
    return x, spark.createDataFrame([(i, (i + s) % n) for i in range(n) for s in (1, 7)], "src long, dst long")


def in_memory(batches):
    """{epoch: [(x, y), ...]} of the drawn batches."""
    out = {}
    for r in batches.orderBy("epoch", "batch").collect():
        out.setdefault(r["epoch"], []).append(tuple(np.array([row[c] for row in r["rows"]]) for c in ("vec", "pvec")))
    return out


def test_batches_are_disjoint_and_bounded(spark):
    x, edges = graph(spark)
    rows = contrastive.drawn(x, edges, CONFIG, 50, range(4)).collect()
    assert len(rows) == 12 and all(len(r["rows"]) == 12 for r in rows)
    near = {(r.src, r.dst) for r in edges.collect()}
    vectors = {tuple(r.vec): r.gid for r in x.collect()}
    for e in range(4):
        ids = [row["gid"] for r in rows if r["epoch"] == e for row in r["rows"]]
        assert len(set(ids)) == 36
    assert all((row["gid"], vectors[tuple(row["pvec"])]) in near for r in rows for row in r["rows"])


def test_summed_gradient_equals_that_of_one_process(spark):
    x, edges = graph(spark)
    batches = contrastive.drawn(x, edges, CONFIG, 50, range(1)).repartition(3)
    w = contrastive.Weights(6, CONFIG).w
    loss, g = contrastive.gradient_of(batches, w, CONFIG)
    own = [contrastive.loss_and_gradient(a, b, w, CONFIG.temperature) for a, b in in_memory(batches)[0]]
    assert abs(loss - np.mean([l for l, _ in own])) < 1e-12
    for k in w:
        assert np.allclose(g[k], np.mean([h[k] for _, h in own], axis=0), atol=1e-12)


def test_training_equals_that_of_one_process(spark):
    """Also over the border of two rounds of drawing; one batch an epoch, as in one process."""
    x, edges = graph(spark)
    config = ContrastiveConfig(epochs=contrastive.EPOCHS + 2, embed_dim=4, hidden_dim=8, batch_size=30, lr=1e-2)
    got, losses = contrastive.fit(x, edges, config)
    batches = in_memory(contrastive.drawn(x, edges, config, 50, range(config.epochs)))
    want, known = contrastive.train([batches[e][0] for e in range(config.epochs)], config)
    assert np.allclose(losses, known) and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_anchors_in_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(2, 23, 6))
    w = contrastive.Weights(6, CONFIG).w
    loss, g = contrastive.loss_and_gradient(x, y, w, 0.2)
    monkeypatch.setattr(contrastive, "ANCHORS", 5)
    again, h = contrastive.loss_and_gradient(x, y, w, 0.2)
    assert abs(loss - again) < 1e-12 and all(np.allclose(g[k], h[k]) for k in w)


@pytest.mark.parametrize("rows", [0, 1])
def test_few_rows(spark, rows):
    x, edges = graph(spark)
    found, losses = contrastive.embed(x.limit(rows), edges.limit(0), CONFIG)
    assert found.count() == rows and len(losses) == (CONFIG.epochs if rows else 0)


def test_untrained_weights_do_not_part_the_planted_groups(spark):
    from slabwise.plans import planted

    x, edges = planted.blobs(spark, "/root/testdata/sf0.001")
    found, _ = contrastive.embed(x, edges, ContrastiveConfig(epochs=0, embed_dim=16, hidden_dim=64))
    right = planted.nearest_blob(found).filter(f"nearest = gid % {planted.BLOBS}").count()
    assert right < 0.85 * x.count()
