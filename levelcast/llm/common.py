"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a join side whose rows have been counted is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

#: Bytes of one Arrow batch sent to a Python worker.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder is made and set as the checkpoint folder if the master is
    local (tests on one machine); on a cluster, where executors could not read it, ValueError is raised.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = tempfile.mkdtemp(prefix="levelcast-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        sc.setCheckpointDir(base)
    return base


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    This cuts the lineage: what follows reads files that outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/levelcast/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The table that ``make`` gives, staged; what was staged while it was made is deleted."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        df = make()
        out = staged(df, label)
    finally:
        _MADE.reset(token)
    for path in made[:-1]:
        _delete(df.sparkSession, path)
    if (outer := _MADE.get()) is not None:
        outer.append(made[-1])
    return out


def release(spark: SparkSession) -> None:
    """Delete the tables this application has staged; results that still read them must have been written."""
    _delete(spark, f"{shared_dir(spark)}/levelcast/{spark.sparkContext.applicationId}")


def dropped(table: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if "/levelcast/" in folder:
            _delete(table.sparkSession, folder)


def sized(side: DataFrame, rows: int) -> DataFrame:
    """``side`` marked for broadcast if its counted ``rows`` are few, else unchanged (shuffle join)."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


#: A key counts as hot from this share of all rows on (and this many rows); so there are at most ``1 / HOT_SHARE`` hot keys.
HOT_SHARE, HOT_ROWS = 1e-4, 10_000


def keyed_join(rows: DataFrame, side: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, a staged table of one row per key whose column ``count`` tells how many ``rows`` have the key.

    A short side, as counted, is broadcast. Else its hot keys are: of these there are at most 10,000
    whatever the table's size, and no task gets all rows of one. The other keys are joined by a shuffle in which
    a key holds at most a ten-thousandth of the rows (or 10,000 rows). ``count`` is left out; keys must not be null.
    """
    n, total = side.agg(F.count(F.lit(1)), F.sum(count)).first()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side.drop(count)), on, how)
    bound = max(HOT_ROWS, int(total * HOT_SHARE))
    hot, cold = side.filter(F.col(count) > bound).drop(count), side.filter(F.col(count) <= bound).drop(count)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold.hint("merge"), on, how)
    return rows.join(F.broadcast(hot.select(*on) if how == "left_semi" else hot), on).unionByName(rest)


def bounded(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers hold, by bytes: 10,000 rows of long texts would be too many.

    Set for the session if it has no bound of its own yet.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(2**31 - 1))) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def key(col: Column | str) -> Column:
    """A non-null string key for a nullable string column: '' is null, '=x' is x."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c.cast("string")))


def held_out(doc_id: Column) -> Column:
    """True for the rows whose CRC-32 of the id's decimal text is divisible by five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with a function made once per task; empty batches are passed over."""

    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows and (out := each(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def grouped(df: DataFrame, key: list[str], each: Callable[[dict[str, np.ndarray | list]], Iterator[tuple]], names: list[str], schema: str) -> DataFrame:
    """``each`` on every group of consecutive equal ``key``, streamed; a group is held whole."""
    at = [df.columns.index(k) for k in key]
    columns = df.columns
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        done: list[tuple] = []

        def close() -> None:
            table = pa.Table.from_batches(held)
            done.extend(each({c: table.column(c).to_pylist() if pa.types.is_binary(table.schema.field(c).type) else table.column(c).to_numpy() for c in columns}))

        def out() -> pa.RecordBatch:
            parts = [np.concatenate(c) for c in zip(*done, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(p) for p in parts], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy() for i in at]
            change = np.zeros(batch.num_rows - 1, bool)
            for k in keys:
                change |= k[1:] != k[:-1]
            heads = np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])
            for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
                own = tuple(k[a] for k in keys)
                if own != now and held:
                    close()
                    held.clear()
                now = own
                held.append(batch.slice(a, b - a))
            if done:
                yield out()
        if held:
            close()
        if done:
            yield out()

    return df.mapInArrow(run, schema)


def missing_columns(df: DataFrame, *names: str) -> None:
    """Raise if ``df`` lacks one of the columns an operator reads."""
    lost = [n for n in names if n not in df.columns]
    if lost:
        raise ValueError(f"columns missing: {', '.join(lost)}")
