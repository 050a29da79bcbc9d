"""Skill of ensembles against observations, and the weights that join two of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col


def skill_metrics(df: DataFrame, observed: str, middle: str, low: str, high: str, by: Sequence[str] = ()) -> DataFrame:
    """Bias, RMSE and share of observations inside the interval."""
    d = F.col(middle) - F.col(observed)
    inside = F.col(observed).between(F.col(low), F.col(high)).cast("double")
    return df.groupBy(*by).agg(F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(inside).alias("coverage"), F.count(F.lit(1)).alias("n"))


def probability_integral(samples: DataFrame, observed: DataFrame, value: str, on: Sequence[str]) -> DataFrame:
    """Share of samples below the observation of each key."""
    o = observed.select(*on, F.col(value).alias("_o"))
    return samples.join(o, list(on)).groupBy(*on).agg(F.avg((F.col(value) < F.col("_o")).cast("double")).alias("pit"))


def coverage_curve(pit: DataFrame, levels: DataFrame) -> DataFrame:
    """Share of keys whose PIT lies in the central interval of each nominal ``level``."""
    inside = F.col("pit").between((1 - F.col("level")) / 2, (1 + F.col("level")) / 2)
    return pit.crossJoin(F.broadcast(levels)).groupBy("level").agg(F.avg(inside.cast("double")).alias("coverage"))


def skill_by_lead(df: DataFrame, lead: str, observed: str, middle: str, width: float = 5.0, least: int = 3) -> DataFrame:
    """Bias and RMSE in bins [lo, lo + width) of lead time with at least ``least`` rows."""
    d = F.col(middle) - F.col(observed)
    return df.groupBy((F.floor(F.col(lead) / width) * width).cast("double").alias("lead_from")).agg(F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def mixture_quantiles(df: DataFrame, value: str, weight: str, quantiles: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles of pooled weighted samples: linear in the cumulated weight of the sorted values."""
    w = Window.partitionBy(*by).orderBy(value)
    line = df.withColumn("_c", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(Window.partitionBy(*by)))
    line = line.withColumn("_pc", F.lag("_c").over(w)).withColumn("_pv", F.lag(value).over(w))
    aggs = []
    for q in quantiles:
        first = F.min_by(F.struct("_pc", "_pv", F.col("_c").alias("c"), F.col(value).alias("v")), F.when(F.col("_c") >= q, F.col("_c")))
        top = F.max(value)
        inside = F.when(first["_pc"].isNull(), first["v"]).otherwise(first["_pv"] + (q - first["_pc"]) / (first["c"] - first["_pc"]) * (first["v"] - first["_pv"]))
        aggs.append(F.coalesce(inside, top).alias(f"q{round(q * 1000):03d}"))
    return line.groupBy(*by).agg(*aggs)


def synthesis_weight(excess: Column | str, centre: float, width: float, form: str = "sigmoid") -> Column:
    """Trend weight by how far a forcing exceeds what was calibrated: sigmoid or exponential decay."""
    x = col(excess)
    if form == "sigmoid":
        return 1 / (1 + F.exp((x - centre) / width))
    if form == "exponential":
        return F.exp(-F.greatest(x - centre, F.lit(0.0)) / width)
    raise ValueError(f"unknown form {form!r}")


def excess_forcing(df: DataFrame, forcing: str, t: str, calibrated: DataFrame, by: Sequence[str] = (), overshoot: bool = True) -> DataFrame:
    """Excess over the largest calibrated forcing (column ``t_cal_max`` of one row), never falling if ``overshoot``."""
    x = F.greatest(F.col(forcing) - F.col("t_cal_max"), F.lit(0.0))
    df = df.crossJoin(F.broadcast(calibrated)).withColumn("excess", x)
    if overshoot:
        df = df.withColumn("excess", F.max("excess").over(Window.partitionBy(*by).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)))
    return df.drop("t_cal_max")


def transition(df: DataFrame, weight: str, threshold: Column, t: str, by: Sequence[str]) -> DataFrame:
    """First time at which the weight falls below each sample's own threshold; null if it never does."""
    return df.groupBy(*by).agg(F.min(F.when(F.col(weight) < threshold, F.col(t))).alias("crossing"))
