"""The classic NetCDF format (versions 1, 2 and 5): headers, byte ranges of variables, and files from arrays.

A header tells where each variable's values lie, so that a range of its leading dimension is one range of bytes. Values of the record (unlimited) dimension are
interleaved: record r of every record variable, then record r + 1. All numbers are big-endian; a variable's bytes are padded to four.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np

#: Reads n bytes at an offset.
Read = Callable[[int, int], bytes]

# Type codes of the format with numpy's types.
KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
CODES = {np.dtype(k): c for c, k in KINDS.items()}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
#: Bytes read first for a header; doubled until it fits.
FIRST_READ = 1 << 14


@dataclass(frozen=True)
class Variable:
    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    kind: np.dtype
    attributes: Mapping[str, object]
    begin: int
    is_record: bool

    @property
    def row_bytes(self) -> int:
        """Bytes of one place of the leading dimension."""
        return int(np.prod(self.shape[1:], dtype=np.int64)) * self.kind.itemsize


@dataclass(frozen=True)
class Header:
    dims: Mapping[str, int]
    attributes: Mapping[str, object]
    variables: Mapping[str, Variable]
    record_bytes: int = 0
    bytes: int = field(default=0, compare=False)


class _Short(Exception):
    """More bytes are needed."""


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at, self.wide = data, 0, False

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise _Short
        self.at += n
        return self.data[self.at - n : self.at]

    def padded(self, n: int) -> bytes:
        out = self.take(n)
        self.take(-n % 4)
        return out

    def int4(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def count(self) -> int:
        return struct.unpack(">q", self.take(8))[0] if self.wide else self.int4()

    def name(self) -> str:
        return self.padded(self.count()).decode("utf-8")

    def entries(self, tag: int) -> range:
        found, n = self.int4(), self.count()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError(f"not a list of kind {tag} at byte {self.at}")
        return range(n)

    def attributes(self) -> dict[str, object]:
        out: dict[str, object] = {}
        for _ in self.entries(ATTRIBUTES):
            name, kind = self.name(), np.dtype(KINDS[self.int4()])
            n = self.count()
            raw = self.padded(n * kind.itemsize)
            values = raw.decode("utf-8", "replace") if kind.kind == "S" else np.frombuffer(raw, kind)
            out[name] = values if isinstance(values, str) else values[0] if n == 1 else values
        return out


def _parsed(data: bytes) -> Header:
    c = _Cursor(data)
    if c.take(3) != b"CDF" or (version := c.take(1)[0]) not in (1, 2, 5):
        raise ValueError("not a classic NetCDF file")
    c.wide = version == 5
    records = c.count()
    dims = [(c.name(), c.count()) for _ in c.entries(DIMENSIONS)]
    attributes = c.attributes()
    unlimited = [n for n, size in dims if size == 0]
    sizes = [(n, records if n in unlimited else size) for n, size in dims]
    found, record_sizes = {}, []
    for _ in c.entries(VARIABLES):
        name = c.name()
        own = [sizes[c.count()] for _ in range(c.count())]
        about, kind = c.attributes(), np.dtype(KINDS[c.int4()])
        c.count()
        begin = c.int4() if version == 1 else struct.unpack(">q", c.take(8))[0]
        is_record = bool(own) and own[0][0] in unlimited
        v = Variable(name, tuple(n for n, _ in own), tuple(s for _, s in own), kind, about, begin, is_record)
        if is_record:
            record_sizes.append(v.row_bytes)
        found[name] = v
    # a single record variable is not padded
    record_bytes = record_sizes[0] if len(record_sizes) == 1 else sum(-(-s // 4) * 4 for s in record_sizes)
    return Header(dict(sizes), attributes, found, record_bytes, c.at)


def header(read: Read, size: int) -> Header:
    """The header of a file of ``size`` bytes."""
    n = FIRST_READ
    while True:
        data = read(0, min(n, size))
        try:
            return _parsed(data)
        except _Short:
            if n >= size:
                raise ValueError("the file ends within its header") from None
            n *= 4


def byte_range(about: Header, name: str, low: int, high: int) -> tuple[int, int]:
    """(offset, bytes) that hold places low to high (exclusive) of a variable's leading dimension."""
    v = about.variables[name]
    if not v.shape:
        return v.begin, v.kind.itemsize
    step = about.record_bytes if v.is_record else v.row_bytes
    return v.begin + low * step, max(0, (high - low - 1) * step + v.row_bytes) if high > low else 0


def stored(about: Header, name: str, read: Read, low: int = 0, high: int | None = None) -> np.ndarray:
    """Stored values of a range of the leading dimension."""
    v = about.variables[name]
    if not v.shape:
        return np.frombuffer(read(*byte_range(about, name, 0, 1)), v.kind)[0]
    high = v.shape[0] if high is None else high
    shape = (high - low, *v.shape[1:])
    if high <= low:
        return np.zeros(shape, v.kind)
    at, n = byte_range(about, name, low, high)
    raw = read(at, n)
    if len(raw) < n:
        raise ValueError(f"the file ends within variable {name}")
    if not v.is_record or about.record_bytes == v.row_bytes:
        return np.frombuffer(raw, v.kind).reshape(shape)
    inner = np.dtype((v.kind, v.shape[1:])) if v.shape[1:] else v.kind
    return np.ndarray((high - low,), inner, raw, strides=(about.record_bytes,)).reshape(shape)


def decoded(v: Variable, values: np.ndarray) -> np.ndarray:
    """Doubles of stored numbers: missing ones are NaN, scale and offset are applied."""
    out = values.astype(np.float64)
    for name in ("_FillValue", "missing_value"):
        if name in v.attributes:
            for mark in np.atleast_1d(v.attributes[name]):
                if not isinstance(mark, str):
                    out[values == np.asarray(mark).astype(values.dtype)] = np.nan
    return out * float(v.attributes.get("scale_factor", 1.0)) + float(v.attributes.get("add_offset", 0.0))


def data_variables(about: Header) -> list[str]:
    """Numeric variables that are not coordinates, those of the most dimensions that the first of them has."""
    own = [v for v in about.variables.values() if v.shape and v.kind.kind != "S" and v.dims != (v.name,)]
    if not own:
        return []
    main = max(own, key=lambda v: len(v.dims))
    return [v.name for v in own if v.dims == main.dims]


def _attribute_bytes(attributes: Mapping[str, object]) -> bytes:
    if not attributes:
        return struct.pack(">ii", 0, 0)
    out = [struct.pack(">ii", ATTRIBUTES, len(attributes))]
    for name, value in attributes.items():
        if isinstance(value, str):
            code, raw, n = 2, value.encode(), len(value.encode())
        else:
            a = np.atleast_1d(np.asarray(value))
            a = a.astype(a.dtype.newbyteorder(">") if a.dtype.newbyteorder(">") in CODES else ">f8")
            code, raw, n = CODES[a.dtype], a.tobytes(), len(a)
        out += [_name(name), struct.pack(">ii", code, n), raw, b"\0" * (-len(raw) % 4)]
    return b"".join(out)


def _name(name: str) -> bytes:
    raw = name.encode()
    return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def encoded(dims: Mapping[str, int], variables: Mapping[str, tuple[Sequence[str], np.ndarray, Mapping[str, object]]], attributes: Mapping[str, object] | None = None, record: str | None = None) -> Iterator[bytes]:
    """The bytes of a file (version 2) with these dimensions and variables (name -> dimensions, values, attributes).

    ``record`` names the unlimited dimension; variables with it must have it first.
    """
    places = list(dims)
    arrays = {n: np.asarray(a, np.asarray(a).dtype.newbyteorder(">")) for n, (_, a, _) in variables.items()}
    recorded = [n for n, (d, _, _) in variables.items() if record is not None and len(d) and d[0] == record]
    size = {n: arrays[n].nbytes // max(1, dims[record]) if n in recorded else arrays[n].nbytes for n in variables}
    pad = {n: 0 if recorded == [n] else -size[n] % 4 for n in variables}
    head = [b"CDF\x02", struct.pack(">i", dims[record] if record is not None else 0), struct.pack(">ii", DIMENSIONS if dims else 0, len(dims))]
    head += [_name(n) + struct.pack(">i", 0 if n == record else s) for n, s in dims.items()]
    head += [_attribute_bytes(attributes or {}), struct.pack(">ii", VARIABLES if variables else 0, len(variables))]
    parts = []
    for n, (own, _, about) in variables.items():
        code = struct.pack(">ii", CODES[arrays[n].dtype], min(size[n] + pad[n], 2**31 - 1))
        parts.append(_name(n) + struct.pack(f">{len(own) + 1}i", len(own), *[places.index(d) for d in own]) + _attribute_bytes(about) + code)
    at = sum(map(len, head)) + sum(len(p) + 8 for p in parts)
    fixed = [n for n in variables if n not in recorded]
    begins = {}
    for n in [*fixed, *recorded]:
        begins[n] = at
        at += size[n] + pad[n]
    yield b"".join([*head, *[p + struct.pack(">q", begins[n]) for n, p in zip(variables, parts, strict=True)]])
    for n in fixed:
        yield arrays[n].tobytes() + b"\0" * pad[n]
    for r in range(dims[record] if record is not None else 0):
        yield b"".join(arrays[n][r : r + 1].tobytes() + b"\0" * pad[n] for n in recorded)
