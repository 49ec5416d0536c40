"""Silhouette by blocks and matrix products against its definition."""

import numpy as np
import pyarrow as pa

from slabwise.operators import metrics
from slabwise.session import ship


def test_rows_are_sent_to_a_bounded_number_of_blocks():
    """Blocks of 2,048 rows sent each of 615,384 rows to 301 blocks."""
    assert [metrics.sides(n) for n in (0, 2048, 5000, 102_564, 615_384)] == [1, 1, 3, 12, 38]


def test_close_rows_lose_no_digits():
    rng = np.random.default_rng(1)
    a = 1e6 + rng.normal(size=(300, 5))
    b = np.concatenate([a[:50], a[50:90] + 1e-9, rng.normal(size=(20, 5))])
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    assert np.allclose(metrics.distances(a, b), want, rtol=1e-9, atol=0)


def test_blocks_equal_the_definition(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(metrics, "BLOCK", 60)
    rng = np.random.default_rng(2)
    x, label = rng.normal(size=(400, 6)), rng.integers(0, 4, 400)
    x[1::7] = x[::7][: len(x[1::7])]
    label[3] = 9  # a label of one row
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(400):
        means = {k: d[i, (label == k) & (np.arange(400) != i)] for k in np.unique(label)}
        own = means.pop(label[i])
        other = min(m.mean() for m in means.values())
        s.append((other - own.mean()) / max(other, own.mean()) if len(own) else 0.0)
    rows = spark.createDataFrame(pa.table({"gid": np.arange(400), "label": label, "vec": pa.array(list(x), pa.list_(pa.float64()))}))
    assert np.isclose(metrics.silhouette(rows).first()[0], np.mean(s), rtol=1e-12)
