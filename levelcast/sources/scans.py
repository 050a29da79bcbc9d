"""Scans of binary grids and of archives as Python data sources, and their writers.

``cells`` reads classic NetCDF files, or such members of zip and gzip files, to a row per cell. A file is split along its leading dimension in byte
ranges, each a partition; an archive is a partition per member, unpacked in a stream to the task's own scratch file. Only the variables of the asked columns are read, and comparisons of
coordinates with literals decide which files' ranges are. ``members`` reads text members of archives line by line.

Paths are URIs that ``pyarrow.fs`` opens (local, HDFS, S3, GCS), files or folders.
"""

from __future__ import annotations

import gzip
import math
import re
import shutil
import tempfile
import zipfile
import zlib
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from . import netcdf

#: Bytes of a variable that a partition reads, about; cells of a batch; bytes of an unpacked member that are held in memory.
SPLIT_BYTES, BATCH_CELLS, MEMORY_BYTES = 32 << 20, 1 << 16, 16 << 20
FILE = "file"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and path of a URI or a plain local path."""
    return pafs.FileSystem.from_uri(uri) if re.match(r"^[a-z][a-z0-9+.-]*:/", uri) else (pafs.LocalFileSystem(), uri)


def listed(uri: str) -> list[tuple[str, int]]:
    """(URI, bytes) of a file, or of the files below a folder in order of name; hidden files are left out."""
    store, path = opened(uri)
    scheme = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    about = store.get_file_info(path)
    if about.type == pafs.FileType.File:
        return [(scheme + path, about.size)]
    if about.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = store.get_file_info(pafs.FileSelector(path, recursive=True))
    return sorted((scheme + f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))


def is_archive(name: str) -> bool:
    return name.endswith((".zip", ".gz"))


def member_names(uri: str) -> list[str]:
    """Members of a zip file in order of name; a gzip file has one, named as the file less ``.gz``. Only the directory of the archive is read."""
    if uri.endswith(".gz"):
        return [uri.rsplit("/", 1)[-1][:-3]]
    store, path = opened(uri)
    with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
        return sorted(i.filename for i in z.infolist() if not i.is_dir())


@contextmanager
def streamed(uri: str, member: str | None) -> Iterator:
    """A member of an archive (or a whole file) as a stream of bytes."""
    store, path = opened(uri)
    with store.open_input_file(path) as f:
        if member is None:
            yield f
        elif uri.endswith(".gz"):
            with gzip.GzipFile(fileobj=f) as g:
                yield g
        else:
            with zipfile.ZipFile(f) as z, z.open(member) as g:
                yield g


@contextmanager
def readable(uri: str, member: str | None) -> Iterator[tuple[netcdf.Read, int]]:
    """(reader of byte ranges, bytes) of a file or of a member; a member is unpacked to a scratch file that ends with the task."""
    if member is None:
        store, path = opened(uri)
        with store.open_input_file(path) as f:
            yield (lambda at, n: f.read_at(n, at)), f.size()
        return
    with tempfile.SpooledTemporaryFile(MEMORY_BYTES) as spool:
        with streamed(uri, member) as f:
            shutil.copyfileobj(f, spool, 1 << 20)
        size = spool.tell()

        def read(at: int, n: int) -> bytes:
            spool.seek(at)
            return spool.read(n)

        yield read, size


@dataclass
class Piece(ds.InputPartition):
    """Places low to high of the leading dimension of a file or member; all places if high is None."""

    uri: str
    member: str | None
    low: int = 0
    high: int | None = None

    @property
    def label(self) -> str:
        return self.uri if self.member is None else f"{self.uri}!{self.member}"


def _pieces(options: Mapping[str, str]) -> list[tuple[Piece, int]]:
    """Files, and members of archives, whose names match; with the bytes of files."""
    match = re.compile(options.get("match", ""))
    out = []
    for uri, size in listed(options["path"]):
        if is_archive(uri):
            out += [(Piece(uri, m), 0) for m in member_names(uri)]
        else:
            out.append((Piece(uri, None), size))
    return [(p, size) for p, size in out if match.search(p.label)]


def problem_of(piece: Piece) -> str | None:
    """What is wrong with a file or member, if its header or the end of a variable cannot be read."""
    try:
        with readable(piece.uri, piece.member) as (read, size):
            about = netcdf.header(read, size)
            if not netcdf.data_variables(about):
                return "no numeric grid"
            for name, v in about.variables.items():
                if v.shape and v.shape[0]:
                    at, n = netcdf.byte_range(about, name, v.shape[0] - 1, v.shape[0])
                    if at + n > size:
                        return f"the file ends within variable {name}"
    except (OSError, ValueError, KeyError, EOFError, zipfile.BadZipFile, zlib.error) as e:
        return str(e) or type(e).__name__
    return None


class CellReader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, options: Mapping[str, str]):
        self.columns, self.options = schema.names, dict(options)
        self.ranges: dict[str, tuple[float, float]] = {}

    def pushFilters(self, filters):
        """Note the ranges that comparisons leave to columns; Spark compares every row again."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if isinstance(f, ds.In):
                values = [v for v in f.value if isinstance(v, (int, float))]
                low, high = (min(values), max(values)) if values and len(values) == len(f.value) else (-math.inf, math.inf)
            elif not isinstance(value, (int, float)):
                low, high = -math.inf, math.inf
            elif isinstance(f, (ds.EqualTo, ds.EqualNullSafe)):
                low = high = value
            elif isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual)):
                low, high = math.nextafter(value, math.inf) if isinstance(f, ds.GreaterThan) else value, math.inf
            elif isinstance(f, (ds.LessThan, ds.LessThanOrEqual)):
                low, high = -math.inf, math.nextafter(value, -math.inf) if isinstance(f, ds.LessThan) else value
            else:
                low, high = -math.inf, math.inf
            if name is not None:
                a, b = self.ranges.get(name, (-math.inf, math.inf))
                self.ranges[name] = max(a, low), min(b, high)
            yield f

    def partitions(self) -> list[Piece]:
        """Byte ranges of large files, whole small ones, members of archives."""
        split = int(self.options.get("splitbytes", SPLIT_BYTES))
        out = []
        for piece, size in _pieces(self.options):
            if piece.member is not None or size <= split or (self.options.get("damaged") == "skip" and problem_of(piece)):
                out.append(piece)
                continue
            with readable(piece.uri, None) as (read, _):
                about = netcdf.header(read, size)
                lead = self._asked(about)[0]
                low, high = self._places(about, lead.dims[0], read)
            rows = max(1, split // max(1, lead.row_bytes))
            out += [Piece(piece.uri, None, a, min(high, a + rows)) for a in range(low, high, rows)]
        return out or [Piece("", None, 0, 0)]

    def _asked(self, about: netcdf.Header) -> list[netcdf.Variable]:
        """The variables to read; where only coordinates are asked, one that tells the grid."""
        own = netcdf.data_variables(about)
        asked = [n for n in self.columns if n in own] or own[:1]
        if not asked:
            raise ValueError("the file has no numeric grid")
        return [about.variables[n] for n in asked]

    def _axis(self, about: netcdf.Header, dim: str, read: netcdf.Read) -> np.ndarray:
        """Coordinates of a dimension; places from 0 where the file has none."""
        v = about.variables.get(dim)
        return netcdf.decoded(v, netcdf.stored(about, dim, read)) if v is not None and v.dims == (dim,) else np.arange(about.dims[dim], dtype=np.float64)

    def _places(self, about: netcdf.Header, dim: str, read: netcdf.Read) -> tuple[int, int]:
        """The places of a dimension between the first and the last that the filters leave."""
        low, high = self.ranges.get(dim, (-math.inf, math.inf))
        if low == -math.inf and high == math.inf:
            return 0, about.dims[dim]
        axis = self._axis(about, dim, read)
        inside = np.flatnonzero((axis >= low) & (axis <= high))
        return (int(inside[0]), int(inside[-1]) + 1) if len(inside) else (0, 0)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.uri or (self.options.get("damaged") == "skip" and problem_of(partition)):
            return
        with readable(partition.uri, partition.member) as (read, size):
            about = netcdf.header(read, size)
            asked = self._asked(about)
            dims = asked[0].dims
            axes, spans = {d: self._axis(about, d, read) for d in dims}, [self._places(about, d, read) for d in dims]
            low, high = max(spans[0][0], partition.low), min(spans[0][1], spans[0][1] if partition.high is None else partition.high)
            inner = tuple(slice(a, b) for a, b in spans[1:])
            cells = int(np.prod([b - a for a, b in spans[1:]], dtype=np.int64))
            rows = max(1, BATCH_CELLS // max(1, cells))
            if not cells:
                return
            for a in range(low, high, rows):
                b = min(high, a + rows)
                grid = [axes[dims[0]][a:b], *(axes[d][s] for d, s in zip(dims[1:], inner, strict=True))]
                made: dict[str, pa.Array] = {}
                for i, d in enumerate(dims):
                    if d in self.columns:
                        shape = [1] * len(dims)
                        shape[i] = -1
                        made[d] = pa.array(np.broadcast_to(grid[i].reshape(shape), [len(g) for g in grid]).ravel())
                for v in asked:
                    if v.name in self.columns:
                        values = netcdf.decoded(v, netcdf.stored(about, v.name, read, a, b)[(slice(None), *inner)]).ravel()
                        made[v.name] = pa.array(values, mask=np.isnan(values))
                n = (b - a) * cells
                if FILE in self.columns:
                    made[FILE] = pa.array([partition.label] * n)
                yield pa.RecordBatch.from_arrays([made[c] if c in made else pa.nulls(n, pa.float64()) for c in self.columns], names=self.columns)


class Cells(ds.DataSource):
    """Classic NetCDF grids, a row per cell."""

    @classmethod
    def name(cls) -> str:
        return "levelcast_cells"

    def schema(self) -> T.StructType:
        first = _pieces(self.options)[0][0]
        with readable(first.uri, first.member) as (read, size):
            about = netcdf.header(read, size)
        own = netcdf.data_variables(about)
        names = [*about.variables[own[0]].dims, *own]
        return T.StructType([*(T.StructField(n, T.DoubleType()) for n in names), T.StructField(FILE, T.StringType())])

    def reader(self, schema: T.StructType) -> CellReader:
        return CellReader(schema, self.options)


class LineReader(ds.DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[Piece]:
        return [p for p, _ in _pieces(self.options)] or [Piece("", None)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        with streamed(partition.uri, partition.member) as f:
            rest, at = b"", 0
            while block := f.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                if lines:
                    yield self._batch(partition, at, lines)
                    at += len(lines)
            if rest:
                yield self._batch(partition, at, [rest])

    @staticmethod
    def _batch(piece: Piece, at: int, lines: list[bytes]) -> pa.RecordBatch:
        texts = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
        return pa.RecordBatch.from_arrays([pa.array([piece.label] * len(texts)), pa.array(range(at, at + len(texts)), pa.int64()), pa.array(texts, pa.string())], names=[FILE, "pos", "value"])


class Members(ds.DataSource):
    """Lines of text files and of text members of archives."""

    @classmethod
    def name(cls) -> str:
        return "levelcast_members"

    def schema(self) -> str:
        return f"{FILE} string, pos long, value string"

    def reader(self, schema: T.StructType) -> LineReader:
        return LineReader(self.options)


def cells(spark: SparkSession, path: str, columns: Sequence[str] | None = None, match: str = "", split_bytes: int = SPLIT_BYTES, damaged: str = "fail") -> DataFrame:
    """Cells of the classic NetCDF files, and such members of archives, at a path: coordinates, variables and ``file`` (archive!member for members).

    ``columns``: those wanted; other variables' bytes are not read. ``match``: a pattern that names must have. Missing values are null, scales and offsets are
    applied. Comparisons of coordinates with literals are pushed to the scan. ``damaged``: whether files that cannot be read ``fail`` the scan or are left out (``skip``;
    ``runs.catalogue`` tells them).
    """
    spark.dataSource.register(Cells)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    scan = spark.read.format(Cells.name()).option("match", match).option("splitBytes", split_bytes).option("damaged", damaged)
    if columns is not None:
        scan = scan.schema(T.StructType([T.StructField(c, T.StringType() if c == FILE else T.DoubleType()) for c in columns]))
    return scan.load(path)


def members(spark: SparkSession, path: str, match: str = "") -> DataFrame:
    """(file, pos, value): the lines of text files and of members of zip and gzip files at a path, a partition per member."""
    spark.dataSource.register(Members)
    return spark.read.format(Members.name()).option("match", match).load(path)


def put(uri: str, blocks: Iterable[bytes]) -> int:
    """Write a file under another name and move it to its own, so that a task that is run again does no harm."""
    store, path = opened(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path.rsplit('/', 1)[0]}/.{path.rsplit('/', 1)[1]}.{id(blocks)}"
    n = 0
    with store.open_output_stream(part) as f:
        for block in blocks:
            f.write(block)
            n += len(block)
    store.move(part, path)
    return n


def grid_of(table: pa.Table, dims: Sequence[str], values: Mapping[str, Mapping[str, object]], record: bool) -> Iterator[bytes]:
    """A file of a table of cells; cells that it lacks, and nulls, are missing. ``values``: variables with their attributes and perhaps ``kind``."""
    axes, at = {}, []
    for d in dims:
        axis, place = np.unique(table.column(d).to_numpy().astype(np.float64), return_inverse=True)
        axes[d] = axis
        at.append(place)
    made = {d: ((d,), axis, {}) for d, axis in axes.items()}
    for name, about in values.items():
        attributes = {k: v for k, v in about.items() if k != "kind"}
        kind = np.dtype(about.get("kind", "f8"))
        x = table.column(name).to_numpy().astype(np.float64)
        x = (x - float(attributes.get("add_offset", 0.0))) / float(attributes.get("scale_factor", 1.0))
        mark = np.iinfo(kind).min if kind.kind == "i" else 9.96921e36
        grid = np.full([len(a) for a in axes.values()], mark, kind)
        known = ~np.isnan(x)
        grid[tuple(p[known] for p in at)] = np.rint(x[known]) if kind.kind == "i" else x[known]
        made[name] = (tuple(dims), grid, {**attributes, "_FillValue": np.array(mark, kind)})
    return netcdf.encoded({d: len(a) for d, a in axes.items()}, made, record=dims[0] if record else None)


def _grouped(df: DataFrame, by: Sequence[str], needed: Sequence[str], write) -> int:
    """Write one file per group by ``write(keys, table)``; the bytes written."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        n = write([k.as_py() for k in key], table)
        return pa.table({"bytes": pa.array([n], pa.int64())})

    return sum(r["bytes"] for r in df.select(*by, *needed).groupBy(*by).applyInArrow(run, "bytes long").groupBy().sum("bytes").withColumnRenamed("sum(bytes)", "bytes").collect() if r["bytes"])


def write_cells(df: DataFrame, folder: str, by: Sequence[str], dims: Sequence[str], values: Mapping[str, Mapping[str, object]], name: str = "{}", record: bool = False) -> int:
    """Write each group's cells as one file, named by the group (``name`` with a place for each key); a group is held by one task. Returns the bytes."""
    return _grouped(df, by, [*dims, *values], lambda keys, table: put(f"{folder}/{name.format(*keys)}.nc", grid_of(table, dims, values, record)))


def write_archives(df: DataFrame, folder: str, archive: str, member: str, dims: Sequence[str], values: Mapping[str, Mapping[str, object]], name: str = "{}", member_name: str = "{}") -> int:
    """Write a zip file per value of ``archive`` with a member per value of ``member``; an archive's cells are held by one task. Returns the bytes."""

    def write(keys: list, table: pa.Table) -> int:
        with tempfile.SpooledTemporaryFile(MEMORY_BYTES) as spool:
            with zipfile.ZipFile(spool, "w", zipfile.ZIP_DEFLATED) as z:
                for m in sorted(set(table.column(member).to_pylist())):
                    own = table.filter(pa.compute.equal(table.column(member), m))
                    z.writestr(f"{member_name.format(m)}.nc", b"".join(grid_of(own, dims, values, False)))
            spool.seek(0)
            return put(f"{folder}/{name.format(*keys)}.zip", iter(lambda: spool.read(1 << 20), b""))

    return _grouped(df, [archive], [member, *dims, *values], write)
