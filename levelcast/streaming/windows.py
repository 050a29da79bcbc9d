"""Streaming extensions: the batch operators' windows over an unbounded input.

The reference computations read finite files; these forms give tumbling and sliding means and
first-row deduplication for late, unordered input, with watermarks that bound their state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_mean(stream: DataFrame, ts: str, value: str, by: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean, deviation and count of fixed windows."""
    g = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *by)
    return g.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n")).select(F.col("window.start").alias("start"), *by, "mean", "std", "n")


def sliding_mean(stream: DataFrame, ts: str, value: str, by: list[str], width: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    g = stream.withWatermark(ts, late).groupBy(F.window(ts, width, step), *by)
    return g.agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(F.col("window.start").alias("start"), *by, "mean", "n")


def first_of_each(stream: DataFrame, ts: str, key: list[str], late: str = "1 hour") -> DataFrame:
    """One row per key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
