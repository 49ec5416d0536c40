"""The data sources mtx and h5ad."""

import sys
import types

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql.types import StructType

from slabwise.session import ship
from slabwise.sources import files, formats


@pytest.fixture
def known(spark):
    ship(spark)
    formats.register(spark)
    return spark


TEXT = "%%MatrixMarket matrix coordinate real general\n% a remark\n%\n\n 4  3 5 \n1 1 2.5\r\n\n% within\n2\t3 -1e-3\n  3   2 7\n4 1 1\n4 3 0.1"
WANT = [(1, 1, 2.5), (2, 3, -0.001), (3, 2, 7.0), (4, 1, 1.0), (4, 3, 0.1)]


@pytest.mark.parametrize("step", [1, 3, 7, 20, 1 << 20])
def test_ranges_cut_anywhere_give_each_line_once(spark, tmp_path, monkeypatch, step):
    (tmp_path / "m.mtx").write_bytes(TEXT.encode())
    source = formats.MatrixMarket({"path": str(tmp_path / "m.mtx"), "rangeBytes": str(step)})
    for chunk in (4, 1 << 20):
        monkeypatch.setattr(formats, "CHUNK", chunk)
        reader = source.reader(StructType.fromDDL(source.schema()))
        got = [tuple(r.values()) for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
        assert got == WANT


def test_round_trip_and_only_asked_columns(known, tmp_path):
    path = f"file:{tmp_path}/m.mtx"
    df = known.range(1, 5001).selectExpr("id as g", "id % 7 + 1 as s", "id / 3 as value", "'x' as other").repartition(5)
    df.write.format("mtx").mode("overwrite").save(path)
    with open(tmp_path / "m.mtx") as f:
        assert [next(f), next(f)] == [formats.BANNER.decode(), "5000 7 5000\n"]
    back = known.read.format("mtx").option("rangeBytes", 9_000).load(path)
    assert back.rdd.getNumPartitions() > 3
    assert sorted(map(tuple, back.collect())) == [(i, i % 7 + 1, i / 3) for i in range(1, 5001)]
    assert known.read.format("mtx").schema("value double, g long").load(path).agg({"g": "sum"}).first()[0] == 5000 * 5001 // 2
    assert [p.name for p in tmp_path.iterdir()] == ["m.mtx"]


def test_written_again_refused_and_empty(known, tmp_path):
    path = str(tmp_path / "m.mtx")
    df = known.createDataFrame([(1, 2, 3.0)], "g long, s long, value double")
    df.write.format("mtx").mode("append").save(path)
    with pytest.raises(PySparkException):
        df.write.format("mtx").mode("append").save(path)
    with pytest.raises(PySparkException):  # the old file stays, and nothing beside it
        df.selectExpr("g", "s", "cast(null as double) as value").write.format("mtx").mode("overwrite").save(path)
    assert [tuple(r) for r in files.read_matrix(known, path).collect()] == [(1, 2, 3.0)]
    assert [p.name for p in tmp_path.iterdir()] == ["m.mtx"]
    df.limit(0).write.format("mtx").mode("overwrite").save(path)
    assert (tmp_path / "m.mtx").read_bytes() == formats.BANNER + b"0 0 0\n" and files.read_matrix(known, path).count() == 0


def test_commit_takes_only_its_messages(tmp_path):
    """A part of an attempt that did not commit is not in the file."""
    import pyarrow as pa

    writer = formats.MatrixWriter(str(tmp_path / "m.mtx"), True)
    batch = lambda g: pa.RecordBatch.from_pydict({"g": [g], "s": [1], "value": [0.5]})
    lost, first, second = (writer.write(iter([batch(g)])) for g in (9, 1, 2))
    assert lost.g == 9
    writer.commit([first, None, second])
    assert (tmp_path / "m.mtx").read_text().splitlines()[1:] == ["2 1 2", "1 1 0.5", "2 1 0.5"]
    other = formats.MatrixWriter(str(tmp_path / "m.mtx"), True)
    other.write(iter([batch(3)]))
    other.abort([None])
    assert [p.name for p in tmp_path.iterdir()] == ["m.mtx"]


class Node(dict):
    """A group of a file in memory."""

    def __init__(self, attrs=None, **items):
        super().__init__(items)
        self.attrs = attrs or {}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


class Text:
    """A data set of strings."""

    dtype = np.dtype("O")

    def __init__(self, *values):
        self.values = np.array(values, dtype=object)

    def asstr(self):
        return self.values

    def __len__(self):
        return len(self.values)


def test_obs_by_ranges_of_rows(spark, monkeypatch):
    """The reader alone, over a stand-in for h5py, which is not there."""
    obs = Node({"_index": "name"}, name=Text(*"abcde"), n=np.arange(5), kind=Node(categories=Text("u", "v"), codes=np.array([0, 1, -1, 1, 0], dtype=np.int8)), late=Node(values=np.array([True] * 5), mask=np.array([0, 0, 0, 1, 0])), odd=Node(other=np.arange(2)))
    file = Node(obs=obs, obsm=Node(spatial=np.arange(10.0).reshape(5, 2)))
    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=lambda path: file))
    source = formats.AnnotatedMatrix({"path": "any", "rows": "2"})
    assert source.schema() == "`name` string, `n` long, `kind` string, `late` boolean, `x` double, `y` double"

    def read(ddl):
        reader = source.reader(StructType.fromDDL(ddl))
        parts = reader.partitions()
        assert [(p.low, p.high) for p in parts] == [(0, 2), (2, 4), (4, 5)]
        return [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]

    assert read(source.schema()) == [("a", 0, "u", True, 0.0, 1.0), ("b", 1, "v", True, 2.0, 3.0), ("c", 2, None, True, 4.0, 5.0), ("d", 3, "v", None, 6.0, 7.0), ("e", 4, "u", True, 8.0, 9.0)]
    assert read("y double, kind string")[2] == (5.0, None)


def test_h5ad_names_the_package_it_lacks(known, monkeypatch):
    monkeypatch.setitem(sys.modules, "h5py", None)
    with pytest.raises(ImportError):
        formats.AnnotatedMatrix({"path": "any"}).schema()
