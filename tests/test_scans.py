"""The NetCDF format by hand-made bytes and round trips; pruning and splitting of the scans; archives."""

import gzip
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelcast.sources import netcdf, scans


def reader(data, log=None):
    def read(at, n):
        if log is not None:
            log.append((at, n))
        return data[at : at + n]

    return read


def test_a_file_written_by_hand():
    """A version 1 file: one dimension of 3, a short variable with a fill value, padded to four bytes."""
    name = lambda s: struct.pack(">i", len(s)) + s + b"\0" * (-len(s) % 4)
    head = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, 1) + name(b"t") + struct.pack(">i", 3)
    head += struct.pack(">ii", 12, 1) + name(b"title") + struct.pack(">ii", 2, 5) + b"hello\0\0\0"
    head += struct.pack(">ii", 11, 1) + name(b"x") + struct.pack(">ii", 1, 0)
    head += struct.pack(">ii", 12, 2) + name(b"_FillValue") + struct.pack(">ii", 3, 1) + struct.pack(">hh", -9, 0) + name(b"scale_factor") + struct.pack(">ii", 6, 1) + struct.pack(">d", 0.5)
    head += struct.pack(">ii", 3, 8)
    data = head + struct.pack(">i", len(head) + 4) + struct.pack(">hhhh", 7, -9, 4, 0)
    about = netcdf.header(reader(data), len(data))
    assert about.dims == {"t": 3} and about.attributes == {"title": "hello"}
    v = about.variables["x"]
    values = netcdf.decoded(v, netcdf.stored(about, "x", reader(data)))
    assert values[0] == 3.5 and np.isnan(values[1]) and values[2] == 2.0


@pytest.mark.parametrize("record", [None, "time"])
@pytest.mark.parametrize("kind", ["i2", "f4", "f8", "i4"])
def test_round_trip_and_byte_ranges(kind, record):
    pick = np.random.default_rng(1)
    grid = pick.integers(-99, 99, (7, 3, 5)).astype(kind)
    small = pick.integers(0, 9, 7).astype("i2")
    variables = {"time": (("time",), np.arange(7.0), {}), "lat": (("lat",), np.array([-1.0, 0, 1]), {"units": "degrees"}), "v": (("time", "lat", "lon"), grid, {"n": np.array([1, 2], "i4")}), "s": (("time",), small, {})}
    data = b"".join(netcdf.encoded({"time": 7, "lat": 3, "lon": 5}, variables, {"a": 1.5}, record))
    log = []
    about = netcdf.header(reader(data), len(data))
    assert list(about.variables) == list(variables) and about.variables["v"].is_record == (record is not None)
    for name, (_, array, _) in variables.items():
        assert (netcdf.stored(about, name, reader(data)) == array).all()
    assert (netcdf.stored(about, "v", reader(data, log), 2, 5) == grid[2:5]).all() and (netcdf.stored(about, "s", reader(data), 6, 7) == small[6:]).all()
    # no more is read than the range's rows (with what lies between them)
    assert len(log) == 1 and log[0][1] <= 3 * max(about.record_bytes, grid[0].nbytes)
    assert netcdf.data_variables(about) == ["v"]


def test_a_single_record_variable_is_not_padded():
    grid = np.arange(15, dtype="i2").reshape(5, 3)
    data = b"".join(netcdf.encoded({"t": 5, "x": 3}, {"v": (("t", "x"), grid, {})}, record="t"))
    about = netcdf.header(reader(data), len(data))
    assert about.record_bytes == 6 and (netcdf.stored(about, "v", reader(data), 1, 4) == grid[1:4]).all()


@pytest.mark.parametrize("data", [b"", b"CDF\x04" + b"\0" * 40, b"\x89HDF\r\n\x1a\n" + b"\0" * 99, b"CDF\x01" + b"\0" * 6])
def test_other_files_are_refused(data):
    with pytest.raises(ValueError):
        netcdf.header(reader(data), len(data))


@pytest.fixture
def field(spark, tmp_path):
    df = spark.range(6 * 4 * 3).select((F.col("id") % 6).cast("double").alias("time"), (F.floor(F.col("id") / 6) % 4 * 10).cast("double").alias("lat"), (F.floor(F.col("id") / 24)).cast("double").alias("lon"), F.when(F.col("id") % 7 != 0, F.col("id").cast("double")).alias("v"), F.lit(1.0).alias("w"), (F.col("id") % 2).alias("file_no"))
    rows = [(r.time, r.lat, r.lon, r.v) for r in df.collect()]
    scans.write_cells(df.withColumn("one", F.lit("all")), str(tmp_path / "f"), ["one"], ["time", "lat", "lon"], {"v": {}, "w": {}}, "{}", record=True)
    return str(tmp_path / "f"), rows


def test_scan_equals_the_cells(spark, field):
    path, rows = field
    df = scans.cells(spark, path)
    assert df.columns == ["time", "lat", "lon", "v", "w", "file"]
    assert sorted((r.time, r.lat, r.lon, r.v is None, r.v or 0) for r in df.collect()) == sorted((t, a, o, v is None, v or 0) for t, a, o, v in rows)
    near = scans.cells(spark, path, ["time", "v"], split_bytes=64).filter("time >= 2 AND time < 4")
    assert sorted((r.time, r.v or 0) for r in near.collect()) == sorted((t, v or 0) for t, _, _, v in rows if 2 <= t < 4)
    assert scans.cells(spark, path, ["lat"]).distinct().count() == 4


def test_filters_and_columns_prune_what_is_read(field, monkeypatch):
    path, rows = field
    read = []
    plain = netcdf.stored
    monkeypatch.setattr(netcdf, "stored", lambda about, name, *a: read.append((name, *a[1:])) or plain(about, name, *a))
    kinds = T.StructType([T.StructField(c, T.DoubleType()) for c in ("time", "lat", "v")])
    scan = scans.CellReader(kinds, {"path": path, "splitbytes": "1"})
    filters = [ds.GreaterThan(("time",), 1), ds.LessThanOrEqual(("time",), 4.0), ds.In(("lat",), (10, 20)), ds.IsNotNull(("v",)), ds.EqualTo(("lon",), 1.0)]
    assert list(scan.pushFilters(filters)) == filters
    pieces = scan.partitions()
    assert [(p.low, p.high) for p in pieces] == [(2, 3), (3, 4), (4, 5)]
    read.clear()
    found = [r for p in pieces for b in scan.read(p) for r in b.to_pylist()]
    assert sorted((r["time"], r["lat"], r["v"] or 0) for r in found) == sorted((t, a, v or 0) for t, a, o, v in rows if 1 < t <= 4 and a in (10, 20) and o == 1)
    assert {name for name, *_ in read} == {"time", "lat", "lon", "v"}
    assert sorted(r for r in read if r[0] == "v") == [("v", 2, 3), ("v", 3, 4), ("v", 4, 5)]


def test_members_of_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x/one.txt", "a\r\nb\n\nc")
        z.writestr("two.txt", "long " * 500_000 + "\nend\n")
        z.writestr("skip.dat", "no")
        grid = np.arange(6.0).reshape(2, 3)
        z.writestr("g.nc", b"".join(netcdf.encoded({"t": 2, "x": 3}, {"v": (("t", "x"), grid, {})})))
    with gzip.open(tmp_path / "b.txt.gz", "wt") as g:
        g.write("ä\nö")
    lines = scans.members(spark, str(tmp_path), r"\.txt$")
    got = {}
    for r in lines.collect():
        got.setdefault(r.file.rsplit("!", 1)[1], []).append((r.pos, r.value))
    assert got["x/one.txt"] == [(0, "a"), (1, "b"), (2, ""), (3, "c")] and got["b.txt"] == [(0, "ä"), (1, "ö")]
    assert [len(v) for _, v in got["two.txt"]] == [2_500_000, 3] and set(got) == {"x/one.txt", "two.txt", "b.txt"}
    assert lines.rdd.getNumPartitions() == 3
    cells = scans.cells(spark, str(tmp_path), match=r"\.nc$")
    assert sorted((r.t, r.x, r.v) for r in cells.collect()) == [(i, j, 3 * i + j) for i in range(2) for j in range(3)]
    assert scans.members(spark, str(tmp_path), "nothing").count() == 0
