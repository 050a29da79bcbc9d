"""Sinks: a partitioned component store, JSON and CSV exports."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_projection(df: DataFrame, path: str) -> None:
    """Write (component, scenario, ...) rows; existing partitions of the same keys are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("component", "scenario").parquet(path)


def save_table(df: DataFrame, path: str, *keys: str) -> None:
    """Replace a table, or only the partitions of ``keys`` that ``df`` has."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    if keys:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*keys)
    w.parquet(path)


def save_metadata(spark: SparkSession, component: str, facts: Mapping[str, object], path: str) -> None:
    """Facts of a component as rows; numbers that are not finite are dropped."""
    rows = [(component, k, str(v)) for k, v in facts.items() if v is not None and not (isinstance(v, float) and not math.isfinite(v))]
    df = spark.createDataFrame(rows, "component string, key string, value string")
    save_table(df, path, "component")


def load_projections(spark: SparkSession, path: str, scenarios: DataFrame | None = None, independent: tuple[str, ...] = ()) -> DataFrame:
    """Projections of all components; those that do not depend on the scenario are repeated for each of ``scenarios``.

    The first scenario such a component was stored under is the one repeated.
    """
    df = spark.read.parquet(path)
    if scenarios is None or not independent:
        return df
    once = df.filter(F.col("component").isin(*independent))
    first = once.groupBy("component").agg(F.min("scenario").alias("scenario"))
    once = once.join(F.broadcast(first), ["component", "scenario"], "left_semi").drop("scenario")
    return df.filter(~F.col("component").isin(*independent)).unionByName(once.crossJoin(F.broadcast(scenarios)))


def inventory(df: DataFrame) -> DataFrame:
    """Components, scenarios and their rows."""
    return df.groupBy("component", "scenario").agg(F.count(F.lit(1)).alias("n"))


def first_samples(df: DataFrame, n: int) -> DataFrame:
    return df.filter(F.col("sample_id") < n)


def export_json(results: Mapping, path: str) -> None:
    """A small nested result to a file on the driver; numbers that are not finite become null."""

    def clean(x):
        if isinstance(x, Mapping):
            return {str(k): clean(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [clean(v) for v in x]
        return None if isinstance(x, float) and not math.isfinite(x) else x

    with open(path, "w") as f:
        json.dump(clean(results), f, indent=2)


def export_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """CSV with numbers of fixed digits."""
    cols = [F.format_string(f"%.{digits}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").csv(path, header=True)
