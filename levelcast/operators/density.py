"""Densities of samples: kernel estimates, histograms, empirical distribution functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kernel_density(df: DataFrame, value: str, grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Gaussian density with Scott's bandwidth (sample deviation times n^-1/5) at the points ``x`` of a short grid."""
    width = df.groupBy(*by).agg((F.stddev_samp(value) * F.pow(F.count(value), -0.2)).alias("_h"))
    joined = df.join(F.broadcast(width), list(by)) if by else df.crossJoin(F.broadcast(width))
    z = (F.col("x") - F.col(value)) / F.col("_h")
    return joined.crossJoin(F.broadcast(grid)).groupBy(*by, "x").agg(F.avg(F.exp(-0.5 * z * z) / (F.col("_h") * math.sqrt(2 * math.pi))).alias("density"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts and densities of equal bins; the last one holds its upper bound."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))
    rows = df.filter(F.col(value).between(low, high)).groupBy(*by, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    n = df.filter(F.col(value).between(low, high)).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(n, list(by)) if by else rows.crossJoin(F.broadcast(n))
    return rows.select(*by, "bin", (low + F.col("bin") * width).alias("left"), "n", (F.col("n") / F.col("_n") / width).alias("density"))


def exceedance_curve(df: DataFrame, value: str, grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per cent of samples above each point ``x``."""
    return df.crossJoin(F.broadcast(grid)).groupBy(*by, "x").agg((F.avg((F.col(value) > F.col("x")).cast("double")) * 100).alias("exceed"))


def compared_quantiles(ours: DataFrame, theirs: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Both sets of quantiles side by side, and the ratio of ours to theirs."""
    b = theirs.select(*on, *[F.col(c).alias(f"{c}_ref") for c in columns])
    out = ours.select(*on, *columns).join(b, list(on))
    return out.withColumns({f"{c}_ratio": F.col(c) / F.col(f"{c}_ref") for c in columns})
