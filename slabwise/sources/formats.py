"""Spark data sources for files of the field: `mtx` (Matrix Market coordinates, read and written) and `h5ad` (spot attributes, read).

Paths are folders that driver and executors share, or addresses that pyarrow opens (hdfs, s3, gs).
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.csv as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes that a task reads, and bytes that are parsed at once.
RANGE, CHUNK = 64 << 20, 4 << 20

BANNER = b"%%MatrixMarket matrix coordinate real general\n"
_REMARK = re.compile(rb"(?m)^[ \t]*(?:%.*)?\r?\n")
_BLANKS, _EDGES = re.compile(rb"[ \t\r]+"), re.compile(rb"(?m)^ | $")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def line_from(f, at: int, low: int, size: int) -> int:
    """The first place from `at` on where a line begins; lines begin at low, and at the place after a line's end."""
    if at <= low:
        return low
    f.seek(at - 1)
    at -= 1
    while at < size and (block := f.read(1 << 16)):
        if (end := block.find(b"\n")) >= 0:
            return at + end + 1
        at += len(block)
    return size


def whole_lines(f, low: int, high: int):
    """The bytes from low to high, which are line starts, in parts of about CHUNK bytes that end with a line's end."""
    f.seek(low)
    rest = b""
    while low < high and (block := f.read(min(CHUNK, high - low))):
        low += len(block)
        cut = block.rfind(b"\n") + 1
        if cut:
            yield rest + block[:cut]
            rest = b""
        rest += block[cut:]
    if rest:
        yield rest + b"\n"


def header(f) -> tuple[str, str, int]:
    """(field, symmetry, where entries begin) of a Matrix Market file; a ValueError for files of another kind."""
    f.seek(0)
    data, lines = b"", []
    while not (lines and lines[-1] and not lines[-1].startswith(b"%")):
        end = data.find(b"\n")
        if end < 0:
            block = f.read(1 << 16)
            if not block:
                if not data.strip():
                    break
                block = b"\n"
            data += block
            continue
        if not lines:
            banner = data[:end].decode("utf-8", "replace").lower().split()
            if banner[:3] != ["%%matrixmarket", "matrix", "coordinate"] or len(banner) < 5 or banner[3] not in ("real", "integer", "pattern") or banner[4] not in ("general", "symmetric"):
                break
            at = 0
        lines.append(data[:end].strip())
        at += end + 1
        data = data[end + 1 :]
    else:
        return banner[3], banner[4], at
    raise ValueError("not a Matrix Market file of coordinates, or one without its size")


def checked(path: str) -> None:
    """A ValueError where path is no Matrix Market file."""
    fs, at = opened(path)
    with fs.open_input_file(at) as f:
        header(f)


@dataclass
class Range(InputPartition):
    low: int
    high: int


class MatrixReader(DataSourceReader):
    """Ranges of bytes, a task each: a line belongs to the range that it begins in. Columns that the given schema leaves out are not handed on."""

    def __init__(self, schema: StructType, path: str, step: int):
        self.names, self.path, self.step = schema.names, path, step

    def partitions(self) -> list[Range]:
        fs, path = opened(self.path)
        with fs.open_input_file(path) as f:
            low, size = header(f)[2], f.size()
        return [Range(at, min(at + self.step, size)) for at in range(low, size, self.step)] or [Range(low, low)]

    def read(self, part: Range):
        fs, path = opened(self.path)
        with fs.open_input_file(path) as f:
            field, symmetry, body = header(f)
            size = f.size()
            columns = {"g": pa.int64(), "s": pa.int64()} | ({} if field == "pattern" else {"value": pa.float64()})
            for block in whole_lines(f, line_from(f, part.low, body, size), line_from(f, part.high, body, size)):
                lines = _EDGES.sub(b"", _BLANKS.sub(b" ", _REMARK.sub(b"", block)))
                if not lines.strip():
                    continue
                t = pc.read_csv(pa.BufferReader(lines), pc.ReadOptions(column_names=list(columns), use_threads=False), pc.ParseOptions(delimiter=" ", quote_char=False), pc.ConvertOptions(column_types=columns))
                if field == "pattern":
                    t = t.append_column("value", pa.array(np.ones(len(t))))
                if symmetry == "symmetric":
                    other = t.filter(pa.compute.not_equal(t["g"], t["s"]))
                    t = pa.concat_tables([t, other.select(["s", "g", "value"]).rename_columns(["g", "s", "value"])])
                yield from t.select(self.names).to_batches()


@dataclass
class Part(WriterCommitMessage):
    place: int
    name: str
    rows: int
    g: int
    s: int


class MatrixWriter(DataSourceArrowWriter):
    """Entries (g, s, value) as one file: tasks write parts beside it, the commit puts those of its messages behind a header and moves the file into place.

    What attempts leave that don't commit goes with the folder. A task fails on a null; the
    file that stood there before stays until the new one is whole.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex
        fs, at = opened(path)
        if not overwrite and fs.get_file_info(at).type != pafs.FileType.NotFound:
            raise ValueError(f"{path} exists: a Matrix Market file can be replaced (mode overwrite), not appended to")

    def folder(self) -> tuple[pafs.FileSystem, str, str]:
        fs, at = opened(self.path)
        return fs, at, f"{at}.parts-{self.run}"

    def write(self, batches) -> Part:
        fs, _, parts = self.folder()
        fs.create_dir(parts, recursive=True)
        name, rows, g, s = f"{parts}/{uuid.uuid4().hex}", 0, 0, 0
        with fs.open_output_stream(name) as out:
            for batch in batches:
                t = pa.table({"g": batch.column("g").cast(pa.int64()), "s": batch.column("s").cast(pa.int64()), "value": batch.column("value").cast(pa.float64())})
                if any(c.null_count for c in t.columns):
                    raise ValueError("an entry without place or value")
                if len(t):
                    pc.write_csv(t, out, pc.WriteOptions(include_header=False, delimiter=" "))
                    rows, g, s = rows + len(t), max(g, pa.compute.max(t["g"]).as_py()), max(s, pa.compute.max(t["s"]).as_py())
        context = TaskContext.get()
        return Part(context.partitionId() if context else 0, name, rows, g, s)

    def commit(self, messages) -> None:
        fs, at, parts = self.folder()
        done = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.place)
        fs.create_dir(parts, recursive=True)
        with fs.open_output_stream(f"{parts}/whole") as out:
            out.write(BANNER + f"{max((m.g for m in done), default=0)} {max((m.s for m in done), default=0)} {sum(m.rows for m in done)}\n".encode())
            for m in done:
                with fs.open_input_stream(m.name) as part:
                    while block := part.read(CHUNK):
                        out.write(block)
        fs.move(f"{parts}/whole", at)
        fs.delete_dir(parts)

    def abort(self, messages) -> None:
        fs, _, parts = self.folder()
        if fs.get_file_info(parts).type != pafs.FileType.NotFound:
            fs.delete_dir(parts)


class MatrixMarket(DataSource):
    """`spark.read.format("mtx").load(path)`: (g, s, value) of real, integer or pattern (value 1) files, general or symmetric (both halves are returned).

    Option rangeBytes: bytes for each task. `df.write.format("mtx").mode("overwrite").save(path)` writes one file of (g, s, value).
    """

    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return "g long, s long, value double"

    def reader(self, schema: StructType) -> MatrixReader:
        if unknown := set(schema.names) - {"g", "s", "value"}:
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        return MatrixReader(schema, self.options["path"], int(self.options.get("rangeBytes", RANGE)))

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        if lost := {"g", "s", "value"} - set(schema.names):
            raise ValueError(f"entries lack the columns {sorted(lost)}")
        return MatrixWriter(self.options["path"], overwrite)


# ---- annotated matrices --------------------------------------------------------------------------
def h5(path: str):
    try:
        import h5py
    except ImportError as e:
        raise ImportError("h5py is needed to read .h5ad files: pip install h5py") from e
    return h5py.File("/" + path[5:].lstrip("/") if path.startswith("file:") else path)


def strings(node, part=slice(None)):
    return node.asstr()[part] if node.dtype.kind == "O" else node[part]


def _kind(node) -> str:
    return {"b": "boolean", "i": "long", "u": "long", "f": "double"}.get(node.dtype.kind, "string")


class SpotReader(DataSourceReader):
    """Rows low to high of obs, a task each, and only the columns of the given schema."""

    def __init__(self, schema: StructType, path: str, step: int):
        self.names, self.path, self.step = schema.names, path, step

    def partitions(self) -> list[Range]:
        with h5(self.path) as f:
            n = spots_in(f)
        return [Range(low, min(low + self.step, n)) for low in range(0, n, self.step)] or [Range(0, 0)]

    def read(self, part: Range):
        at = slice(part.low, part.high)
        with h5(self.path) as f:
            columns = [column_of(f, name, at) for name in self.names]
        if part.high > part.low:
            yield pa.RecordBatch.from_arrays(columns, names=self.names)


def spots_in(f) -> int:
    """Rows of obs, by its index or any column."""
    obs = f["obs"]
    node = obs[obs.attrs["_index"]] if "_index" in obs.attrs else next(iter(obs.values()))
    return len(node["codes" if "codes" in node else "values"]) if hasattr(node, "items") else len(node)


def columns_of(f) -> dict[str, str]:
    """Names and types of obs, categories by the type of their values, and x and y where obsm has places."""
    out = {}
    for name, node in f["obs"].items():
        inner = "categories" if hasattr(node, "items") and "categories" in node else "values" if hasattr(node, "items") and "values" in node else None
        if inner or not hasattr(node, "items"):
            out[name] = _kind(node[inner] if inner else node)
    return out | ({"x": "double", "y": "double"} if "obsm" in f and "spatial" in f["obsm"] else {})


def column_of(f, name: str, at: slice) -> pa.Array:
    types = {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    if name in ("x", "y") and "obsm" in f and "spatial" in f["obsm"]:
        return pa.array(np.asarray(f["obsm"]["spatial"][at, "xy".index(name)], float))
    node = f["obs"][name]
    if not hasattr(node, "items"):
        return pa.array(strings(node, at)).cast(types[_kind(node)])
    if "categories" in node:
        code = np.asarray(node["codes"][at])
        return pa.array(strings(node["categories"])).cast(types[_kind(node["categories"])]).take(pa.array(code, pa.int64(), mask=code < 0))
    return pa.array(strings(node["values"], at), mask=np.asarray(node["mask"][at], bool)).cast(types[_kind(node["values"])])


class AnnotatedMatrix(DataSource):
    """`spark.read.format("h5ad").load(path)`: obs with x and y of obsm/spatial, by ranges of rows (option rows, 10,000); h5py is optional."""

    @classmethod
    def name(cls) -> str:
        return "h5ad"

    def schema(self) -> str:
        with h5(self.options["path"]) as f:
            return ", ".join(f"`{name}` {kind}" for name, kind in columns_of(f).items())

    def reader(self, schema: StructType) -> SpotReader:
        return SpotReader(schema, self.options["path"], int(self.options.get("rows", 10_000)))


def register(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    for source in (MatrixMarket, AnnotatedMatrix):
        spark.dataSource.register(source)
