"""Model runs in a tree of files: catalogue, control pairing, members on a common grid.

A run is a file whose path tells its group, model and experiment. What a model does without forcing (its control) is taken off each of its other runs, on the control's own
times; members are then brought to one grid and one baseline before statistics are taken over them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, align, sequence
from . import scans

KEYS = ("group", "model", "experiment")
#: .../<group>/<model>/<experiment>/<file>.nc
PATTERN = r"([^/]+)/([^/]+)/([^/]+)/[^/]+\.nc$"


def keyed(df: DataFrame, file: str = "file", pattern: str = PATTERN, names: Sequence[str] = KEYS) -> DataFrame:
    """Columns of the groups of a pattern in the files' paths; files that do not match are left out."""
    return df.filter(F.col(file).rlike(pattern)).withColumns({n: F.regexp_extract(file, pattern, i) for i, n in enumerate(names, 1)})


def catalogue(spark: SparkSession, path: str, pattern: str = PATTERN, names: Sequence[str] = KEYS) -> DataFrame:
    """(file, length, names..., problem): every file of the tree that matches, and what is wrong with those that cannot be read, null for the others.

    Headers are read by tasks, not by the driver.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scans.problem_of(scans.Piece(f, None)) for f in b.column("file").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, "problem"])

    found = keyed(files, "file", pattern, names)
    return found.mapInArrow(run, found.schema.simpleString()[7:-1] + ",problem:string")


def cells(spark: SparkSession, path: str, columns: Sequence[str], pattern: str = PATTERN, names: Sequence[str] = KEYS) -> DataFrame:
    """Cells of all readable runs, with the columns of their paths; unreadable files are left out (``catalogue`` reports them)."""
    return keyed(scans.cells(spark, path, [*columns, "file"], damaged="skip"), "file", pattern, names).drop("file")


def less_control(runs: DataFrame, value: str, t: str, control: Column, by: Sequence[str] = ("group", "model"), run: str = "experiment") -> DataFrame:
    """Every run less the control of the same ``by``, at the control's times (the run is interpolated; its ends are held). Runs without a control are left out."""
    base = runs.filter(control).select(*by, t, F.col(value).alias("_base"))
    others = runs.filter(~control).select(*by, run, t, value)
    asked = others.select(*by, run).distinct().join(base, list(by))
    out = align.interpolate(asked, others, t, [value], [*by, run])
    return out.withColumn(value, F.col(value) - F.col("_base")).drop("_base")


def on_common_grid(members: DataFrame, value: str, t: str, member: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """All members at the times of the first one (in order of ``member``) of each ``by``; their ends are held."""
    first = members.groupBy(*by).agg(F.min(F.struct(*member)).alias("_m"))
    own = members.withColumn("_m", F.struct(*member))
    grid = (own.join(first, [*by, "_m"], "left_semi") if by else own.join(F.broadcast(first), "_m", "left_semi")).select(*by, t).distinct()
    asked = members.select(*by, *member).distinct()
    asked = asked.join(grid, list(by)) if by else asked.join(F.broadcast(grid))
    return align.interpolate(asked, members.select(*by, *member, t, value), t, [value], [*by, *member])


def ensemble_stats(members: DataFrame, value: str, t: str, baseline: float, member: Sequence[str] = ("group", "model"), by: Sequence[str] = ("experiment",)) -> DataFrame:
    """Quantiles over members on a common grid, each less its value at the time nearest to ``baseline``, by ``by`` and time."""
    same = on_common_grid(members, value, t, member, by)
    return aggregate.quantile_summary(sequence.rebased(same, value, t, baseline, [*by, *member]), value, [*by, t])
