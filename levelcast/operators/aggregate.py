"""Aggregations of series and ensembles: exact quantiles, exceedance, variance, weighted means, trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import damage
from .quantiles import summarised

QUANTILES = {"p05": 0.05, "p17": 0.17, "p50": 0.5, "p83": 0.83, "p95": 0.95}


def quantile_summary(df: DataFrame, value: str, by: Sequence[str], quantiles: dict[str, float] | None = None, kept: bool = True) -> DataFrame:
    """Exact quantiles with linear interpolation, mean and population deviation, of groups of any size (``quantiles.summarised``)."""
    return summarised(df, value, by, quantiles or QUANTILES, kept=kept)


def exact_mean(value: str) -> Column:
    """Mean of doubles as an aggregate whose sum is exact and rounded once, so that no order of rows or tasks shows in its last bits.

    Values are added as whole numbers and two pieces of 30 bits of the fraction (bits below 2**-60 are dropped); values of 2**40 or more, infinite ones and NaN are added as
    doubles. Nulls are left out. A sum of 2**63 or more raises an error.
    """
    v = F.col(value).cast("double")
    small = F.abs(v) < 2.0**40
    within = F.when(small, v)
    whole = within.cast("long")
    high = ((within - whole) * 2.0**30).cast("long")
    low = (((within - whole) * 2.0**30 - high) * 2.0**30).cast("long")
    at = lambda c, scale: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)") * F.lit(scale).cast("decimal(19,0)")
    total = (at(whole, 2**30) + at(high, 1)).cast("decimal(38,0)") * F.lit(2**30).cast("decimal(10,0)")
    exact = (total.cast("decimal(38,0)") + at(low, 1)).cast("decimal(38,0)").cast("double") / 2.0**60
    return (exact + F.coalesce(F.sum(F.when(~small, v)), F.lit(0.0))) / F.when(F.count(v) > 0, F.count(v))


def component_sum(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Sum of components sample by sample: row i of each is the same world."""
    return df.groupBy(*by).agg(F.sum(value).alias(value))


def without(total: DataFrame, part: DataFrame, instead: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Totals with one component exchanged for another of the same sample."""
    a = part.select(*on, F.col(value).alias("_a"))
    b = instead.select(*on, F.col(value).alias("_b"))
    return total.join(a, list(on)).join(b, list(on)).select(*on, (F.col(value) - F.col("_a") + F.col("_b")).alias(value))


def exceedance(df: DataFrame, value: str, by: Sequence[str], thresholds: dict[str, float], offset: float = 0.0) -> DataFrame:
    """Per cent of samples above each threshold less ``offset``."""
    return df.groupBy(*by).agg(*[(F.avg((F.col(value) > t - offset).cast("double")) * 100).alias(n) for n, t in thresholds.items()])


def variance_fractions(df: DataFrame, value: str, component: str, sample: str, by: Sequence[str], normalise: bool = True) -> DataFrame:
    """Population variance of each component over that of the samples' totals (at least 1e-30).

    ``raw_sum``: the shares' sum before they are normalised to one.
    """
    parts = df.groupBy(*by, component).agg(F.var_pop(value).alias("_v"))
    totals = df.groupBy(*by, sample).agg(F.sum(value).alias("_s")).groupBy(*by).agg(F.greatest(F.var_pop("_s"), F.lit(1e-30)).alias("_t"))
    share = parts.join(totals, list(by)).withColumn("fraction", F.col("_v") / F.col("_t"))
    sums = share.groupBy(*by).agg(F.sum("fraction").alias("raw_sum"))
    out = share.join(sums, list(by))
    if normalise:
        out = out.withColumn("fraction", F.col("fraction") / F.col("raw_sum"))
    return out.select(*by, component, "fraction", "raw_sum")


def total_variance(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the groups' variances, variance of their means, and the sum of both."""
    g = df.groupBy(*by, group).agg(F.var_pop(value).alias("_v"), F.avg(value).alias("_m"))
    return g.groupBy(*by).agg(F.avg("_v").alias("within"), F.var_pop("_m").alias("across"), (F.avg("_v") + F.var_pop("_m")).alias("total"))


def covariance_sum(df: DataFrame, value: str, component: str, sample: str, by: Sequence[str]) -> DataFrame:
    """Twice the sum of all pairs' sample covariances: var(sum) less the sum of variances (n - 1)."""
    totals = df.groupBy(*by, sample).agg(F.sum(value).alias("_s")).groupBy(*by).agg(F.var_samp("_s").alias("_t"))
    parts = df.groupBy(*by, component).agg(F.var_samp(value).alias("_v")).groupBy(*by).agg(F.sum("_v").alias("_p"))
    return totals.join(parts, list(by)).select(*by, (F.col("_t") - F.col("_p")).alias("covariance_sum"))


def pair_covariances(df: DataFrame, value: str, component: str, sample: str, by: Sequence[str]) -> DataFrame:
    """Sample covariance of each pair of components over common samples."""
    b = df.select(*by, sample, F.col(component).alias("other"), F.col(value).alias("_w"))
    return df.join(b, [*by, sample]).filter(F.col(component) < F.col("other")).groupBy(*by, component, "other").agg(F.covar_samp(value, "_w").alias("covariance"))


def residual_attribution(df: DataFrame, observed: DataFrame, value: str, component: str, by: Sequence[str]) -> DataFrame:
    """The gap between an observed total and the sum of medians, shared out by variance."""
    g = df.groupBy(*by, component).agg(F.median(value).alias("_m"), F.var_pop(value).alias("_v"))
    t = g.groupBy(*by).agg(F.sum("_m").alias("_tm"), F.sum("_v").alias("_tv"))
    out = g.join(t, list(by)).join(observed.select(*by, F.col(value).alias("_o")), list(by))
    return out.select(*by, component, ((F.col("_o") - F.col("_tm")) * F.col("_v") / F.col("_tv")).alias("shift"))


def closure(df: DataFrame, total: str, parts: str, t: str, epochs: dict[str, tuple[float, float]], by: Sequence[str] = ()) -> DataFrame:
    """Ratio of the slopes of the parts' sum and of the total in each epoch."""
    out = None
    for name, (a, b) in epochs.items():
        e = df.filter(F.col(t).between(a, b)).groupBy(*by).agg(F.regr_slope(parts, t).alias("parts_slope"), F.regr_slope(total, t).alias("total_slope")).withColumn("epoch", F.lit(name))
        out = e if out is None else out.unionByName(e)
    return out.withColumn("ratio", F.col("parts_slope") / F.col("total_slope"))


def weighted_mean(df: DataFrame, value: str, weight: Column | str, by: Sequence[str]) -> DataFrame:
    """Weighted mean and deviation over the rows that have a value."""
    w = F.col(weight) if isinstance(weight, str) else weight
    ok = F.col(value).isNotNull()
    s0, s1, s2 = (F.sum(F.when(ok, w * x)) for x in (F.lit(1.0), F.col(value), F.col(value) * F.col(value)))
    return df.groupBy(*by).agg((s1 / s0).alias("mean"), F.sqrt(F.greatest(s2 / s0 - (s1 / s0) * (s1 / s0), F.lit(0.0))).alias("std"))


def two_stage_mean(df: DataFrame, value: str, weight: Column | str, cell: Sequence[str], time: str) -> DataFrame:
    """Mean over depth in each cell, then the weighted mean over cells."""
    cells = df.groupBy(time, *cell).agg(F.avg(value).alias(value))
    return weighted_mean(cells, value, weight, [time])


def mass_integral(df: DataFrame, height: str, area: Column | str, by: Sequence[str], sigma: str | None = None, scale: float = 1e-5) -> DataFrame:
    """Sum of height times area, and the root of the sum of squared errors."""
    a = F.col(area) if isinstance(area, str) else area
    aggs = [(F.sum(F.col(height) * a) * scale).alias("mass")]
    if sigma:
        aggs.append((F.sqrt(F.sum(F.pow(F.col(sigma) * a, 2))) * scale).alias("mass_sigma"))
    return df.groupBy(*by).agg(*aggs)


def consistency(df: DataFrame, value: str, by: Sequence[str] = (), most: float = 0.5) -> DataFrame:
    """Mean, deviation and their ratio over scenarios, and whether the ratio is small."""
    out = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.withColumn("cv", F.col("std") / F.abs("mean")).withColumn("consistent", F.col("cv") < most)


def grid_summary(df: DataFrame, value: str, by: Sequence[str] = (), least_n: int = 30) -> DataFrame:
    """Mean, median, deviation, extremes over the pairs of a grid with enough observations."""
    return df.filter(F.col("n_obs") >= least_n).groupBy(*by).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(F.lit(1)).alias("n_pairs"))


def lag_scan(df: DataFrame, knots: DataFrame, lags: DataFrame, y: str, x: str, t: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of y with x interpolated at t - lag, for each candidate lag with over 3 pairs."""
    from .align import lagged_interpolate

    pairs = lagged_interpolate(df, knots, lags, t, [x], by, outside="null").filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pairs.groupBy(*by, "lag").agg(F.corr(y, x).alias("r"), F.count(F.lit(1)).alias("n")).filter("n > 3")


def best_lag(scan: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The lag of the highest correlation, the smallest of several."""
    return scan.filter("r is not null and not isnan(r)").groupBy(*by).agg(F.min_by("lag", F.struct(-F.col("r"), F.col("lag"))).alias("lag"), F.max("r").alias("r"))


def entity_trends(df: DataFrame, value: str, t: str, entity: str, split: float) -> DataFrame:
    """Per entity: early and late mean, their difference, slope."""
    return df.groupBy(entity).agg(F.avg(F.when(F.col(t) < split, F.col(value))).alias("early"), F.avg(F.when(F.col(t) >= split, F.col(value))).alias("late"), F.regr_slope(value, t).alias("slope"), F.count(F.lit(1)).alias("n")).withColumn("change", F.col("late") - F.col("early"))


def misfit(df: DataFrame, observed: str, modelled: str, sigma: str, by: Sequence[str] = ()) -> DataFrame:
    """Bias, RMSE, and chi-square per row."""
    d = F.col(modelled) - F.col(observed)
    return df.groupBy(*by).agg(F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.pow(d / F.col(sigma), 2)).alias("chi2"), F.count(F.lit(1)).alias("n"))


def risk_shares(df: DataFrame, value: str, component: str, sample: str, by: Sequence[str]) -> DataFrame:
    """Expected damage of the total, shared out in proportion to the components' means.

    This is a proportional share, not a Shapley value; it adds up as far as the means do.
    """
    totals = df.groupBy(*by, sample).agg(F.sum(value).alias("_s")).groupBy(*by).agg(F.avg("_s").alias("_t"), F.avg(damage("_s")).alias("expected_damage"))
    means = df.groupBy(*by, component).agg(F.sum(value).alias("_c"))
    n = df.groupBy(*by).agg(F.countDistinct(sample).alias("_n"))
    return means.join(totals, list(by)).join(n, list(by)).select(*by, component, "expected_damage", (F.col("_c") / F.col("_n") / F.col("_t") * F.col("expected_damage")).alias("risk"))
