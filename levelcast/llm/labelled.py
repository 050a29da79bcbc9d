"""Bounded labelled samples for the classifiers, and words of a text."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Labelled rows that a classifier is fitted on at most, of each class.
MOST_PER_CLASS = 3000
#: Bytes of their features, of each class; rows beyond are left out, those with the largest hashes first.
MOST_BYTES = 64 << 20
#: Different words whose features a task keeps at a time.
CACHE = 200_000


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST_PER_CLASS) -> tuple[DataFrame, float]:
    """(doc_id, text, y) of at most ``most`` rows of each class, and the share of class 1 among all labels.

    Held-out rows never enter. The rows with the smallest hashes of their ids are taken, so
    reruns agree. A document labelled twice counts as 1 if one label says so; of several
    texts of one id the smallest is taken.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = known.filter(~common.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = known.agg(F.avg("y")).first()[0]
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    part = [known.filter(F.col("y") == y).orderBy(*order).limit(most) for y in (0, 1)]
    few = common.staged(part[0].unionByName(part[1]), f"sample-{label}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return rows.select("doc_id", "text", "y"), share if share is not None else 0.5


def gathered(rows: DataFrame, features: Callable[[], Callable[[str], tuple[np.ndarray, np.ndarray]]]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Labels, bucket numbers and counts of the sampled rows, in order of doc_id, on the driver: at most MOST_BYTES a class."""

    def make():
        look = features()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [look(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([c.astype("<f4").tobytes() for _, c in found], pa.binary())], names=["doc_id", "y", "ids", "counts"])

        return each

    found = common.staged(common.map_arrow(rows, make, "doc_id long, y int, ids binary, counts binary"), "sample-features")
    size = (F.length("ids") + F.length("counts")).cast("long")
    upto = F.sum("size").over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    fit = common.staged(found.select("doc_id", "y", size.alias("size")).withColumn("upto", upto).filter(F.col("upto") <= MOST_BYTES).select("doc_id"), "sample-fit")
    table = found.join(F.broadcast(fit), "doc_id", "left_semi").orderBy("doc_id").toArrow()
    y = table.column("y").to_numpy().astype(np.int64)
    return y, [np.frombuffer(b, "<i4") for b in table.column("ids").to_pylist()], [np.frombuffer(b, "<f4") for b in table.column("counts").to_pylist()]


def scores(docs: DataFrame, make_scorer: Callable[[], Callable[[str], float]], cut: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a null text is scored as an empty one."""

    def make():
        score = make_scorer()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column(0)
            out = np.array([score(t or "") for t in batch.column(1).to_pylist()], float)
            held = pa.array([None if i is None else zlib.crc32(str(i).encode()) % 5 == 0 for i in ids.to_pylist()], pa.bool_())
            return pa.RecordBatch.from_arrays([ids, held, pa.array(out), pa.array((out >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

        return each

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, held_out boolean, score double, predicted int")


def batches(n: int, size: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """The numbers below ``n`` in random order, ``size`` at a time."""
    order = rng.permutation(n)
    for i in range(0, n, size):
        yield order[i : i + size]
