"""Spans of a text: what the detectors of personal data and of secrets return."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

Span = tuple[str, int, int]


def joined(spans: Iterable[Span]) -> str:
    """kind:start:end of each span, in the given order, comma-joined; code points, end exclusive."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def apart(spans: Sequence[Span], taken: Sequence[Span]) -> list[Span]:
    """The ``spans`` that overlap none of ``taken`` and none chosen before them."""
    starts: list[int] = []  # disjoint stretches in use, in order
    ends: list[int] = []
    for _, a, b in sorted(taken, key=lambda s: s[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    chosen: list[Span] = []
    for s in spans:
        i = bisect_left(starts, s[2])  # the stretches before i begin before the span ends
        if i and ends[i - 1] > s[1]:
            continue
        chosen.append(s)
        starts.insert(i, s[1])
        ends.insert(i, s[2])
    return chosen


def report(docs: DataFrame, kinds: Sequence[str], find: Callable[[], Callable[[str], tuple[list[Span], list[Span]]]]) -> DataFrame:
    """doc_id, n_<kind> of the base ``kinds``, base_sha256 and spans, for every row.

    ``find()`` makes, once per task, a function from a text to its base spans and all its spans.
    """
    common.missing_columns(docs, "doc_id", "text")
    names = ["doc_id", *(f"n_{k}" for k in kinds), "base_sha256", "spans"]
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in kinds) + ", base_sha256 string, spans string"

    def make():
        look = find()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [look(t or "") for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in kinds]
            sha = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows])
            return pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([joined(every) for _, every in rows])], names=names)

        return each

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, schema)


def masked(text: str, spans: Iterable[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans give one mark."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < at:
            if b > at:
                at = b
            continue
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*out, text[at:]])


def rewritten(docs: DataFrame, find: Callable[[], Callable[[str], tuple[list[Span], list[Span]]]]) -> DataFrame:
    """``docs`` with the spans of each text masked; other columns, rows and null texts unchanged.

    The column n_chars, where there is one, follows the new text.
    """
    common.missing_columns(docs, "text")
    names, at = docs.columns, docs.columns.index("text")

    def make():
        look = find()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [None if t is None else masked(t, look(t)[1]) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                old = batch.column(k).to_pylist()
                columns[k] = pa.array([o if o is None or t is None else len(t) for o, t in zip(old, texts, strict=True)], batch.column(k).type)
            return pa.RecordBatch.from_arrays(columns, names=names)

        return each

    return common.map_arrow(docs, make, docs.schema)
