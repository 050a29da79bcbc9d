"""Decisions under an ensemble of levels: expected cost, optimal defence, value of information.

The cost of a design is linear in the samples' damage, so a grid of designs is one short table
crossed with the samples and one aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import annuity, capital_recovery, damage


def adaptation_cost() -> float:
    """Annual cost (billion dollars) of a metre of defence."""
    return C.CAPITAL_PER_M_BUSD * capital_recovery()


def design_grid(spark: SparkSession, start: float, step: float, n: int, name: str = "design") -> DataFrame:
    return spark.range(n).select((F.lit(start) + F.col("id") * step).alias(name))


def expected_costs(samples: DataFrame, value: str, designs: DataFrame, by: Sequence[str] = (), scale: float = 1.0) -> DataFrame:
    """Cost of each design: adaptation plus the mean damage of what overtops it."""
    over = F.greatest(F.col(value) - F.col("design"), F.lit(0.0))
    grid = samples.crossJoin(F.broadcast(designs))
    return grid.groupBy(*by, "design").agg((adaptation_cost() * F.first("design") + scale * F.avg(damage(over))).alias("cost"))


def optimal_design(costs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The cheapest design, the lowest of several."""
    return costs.groupBy(*by).agg(F.min_by("design", F.struct("cost", "design")).alias("design"), F.min("cost").alias("cost"))


def unstable_samples(full: DataFrame, stable: DataFrame, value: str, by: Sequence[str] = (), least: int = 20) -> DataFrame:
    """Samples above the stable ensemble's 97.5th percentile, or its 90th if those are fewer than ``least``.

    ``n_unstable`` counts them.
    """
    cuts = stable.groupBy(*by).agg(F.percentile(value, [0.9, 0.975]).alias("_q"))
    joined = full.join(cuts, list(by)) if by else full.crossJoin(F.broadcast(cuts))
    w = Window.partitionBy(*by)
    high = F.sum((F.col(value) > F.col("_q")[1]).cast("long")).over(w)
    cut = F.when(high >= least, F.col("_q")[1]).otherwise(F.col("_q")[0])
    return joined.withColumn("_cut", cut).filter(F.col(value) > F.col("_cut")).withColumn("n_unstable", F.count(F.lit(1)).over(w)).drop("_q", "_cut")


def perfect_information(full: DataFrame, stable: DataFrame, value: str, designs: DataFrame, by: Sequence[str] = (), p_stable: float = C.P_STABLE) -> DataFrame:
    """Annual value of knowing whether the ice is stable; zero where fewer than 10 samples are unstable."""
    unstable = unstable_samples(full, stable, value, by)
    best = lambda df, name: expected_costs(df, value, designs, by).groupBy(*by).agg(F.min("cost").alias(name))
    n = unstable.groupBy(*by).agg(F.count(F.lit(1)).alias("n_unstable"))
    parts = [best(full, "c_uncertain"), best(stable, "c_stable"), best(unstable, "c_unstable"), n]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(by), "left") if by else out.crossJoin(F.broadcast(p))
    gain = F.greatest(F.col("c_uncertain") - (p_stable * F.col("c_stable") + (1 - p_stable) * F.col("c_unstable")), F.lit(0.0))
    return out.withColumn("evpi", F.when(F.coalesce(F.col("n_unstable"), F.lit(0)) >= 10, gain).otherwise(0.0))


def gaussian_smoothed(df: DataFrame, value: str, position: str, sigma: float, out: str) -> DataFrame:
    """Gaussian filter of a series on unit steps (positions 0..n-1), cut at 4 sigma, mirrored at the ends."""
    reach = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(weights)
    offsets = df.sparkSession.createDataFrame([(k, w / total) for k, w in zip(range(-reach, reach + 1), weights, strict=True)], "k int, w double")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    at = df.select(position).crossJoin(F.broadcast(offsets)).crossJoin(F.broadcast(n)).withColumn("_j", F.pmod(F.col(position) + F.col("k"), 2 * F.col("_n")))
    at = at.withColumn("_j", F.when(F.col("_j") >= F.col("_n"), 2 * F.col("_n") - 1 - F.col("_j")).otherwise(F.col("_j")))
    vals = df.select(F.col(position).alias("_j"), F.col(value).alias("_v"))
    smooth = at.join(vals, "_j").groupBy(position).agg(F.sum(F.col("w") * F.col("_v")).alias(out))
    return df.join(smooth, position)


def value_surface(values: DataFrame, value: str, arrivals: DataFrame) -> DataFrame:
    """Value (trillion dollars) of information by target year and year of arrival; nothing for later arrivals."""
    return values.crossJoin(F.broadcast(arrivals)).filter("arrival < target").select("target", "arrival", (F.col(value) * annuity("arrival", "target") / 1000).alias("voi"))


def stability_surface(stable: DataFrame, unstable: DataFrame, value: str, designs: DataFrame, weights: DataFrame, arrivals: DataFrame, target: float = 2100.0) -> DataFrame:
    """Value of resolving the stable share ``p`` by arrival year: hedged cost less that with perfect knowledge."""
    a = expected_costs(stable, value, designs).withColumnRenamed("cost", "_a")
    b = expected_costs(unstable, value, designs).withColumnRenamed("cost", "_b")
    both = a.join(b, "design").crossJoin(F.broadcast(weights))
    p = F.col("p")
    gain = both.groupBy("p").agg(F.min(p * F.col("_a") + (1 - p) * F.col("_b")).alias("_h"), F.min("_a").alias("_ma"), F.min("_b").alias("_mb"))
    gain = gain.withColumn("evsi", F.greatest(F.col("_h") - (p * F.col("_ma") + (1 - p) * F.col("_mb")), F.lit(0.0)))
    return gain.crossJoin(F.broadcast(arrivals)).select("p", "arrival", (F.col("evsi") * annuity("arrival", F.lit(target)) / 1000).alias("voi"))


def threshold_surface(full: DataFrame, stable: DataFrame, value: str, thresholds: DataFrame, arrivals: DataFrame, target: float = 2100.0) -> DataFrame:
    """Shift of the exceedance probability at each threshold, and the damage it is worth by arrival year."""
    share = lambda df, name: df.crossJoin(F.broadcast(thresholds)).groupBy("threshold").agg(F.avg((F.col(value) > F.col("threshold")).cast("double")).alias(name))
    both = share(full, "_f").join(share(stable, "_s"), "threshold")
    shift = (F.col("_f") - F.col("_s")) * 100
    return both.crossJoin(F.broadcast(arrivals)).select("threshold", "arrival", shift.alias("delta_exceedance"), (shift / 100 * damage("threshold") * annuity("arrival", F.lit(target)) / 1000).alias("voi"))
