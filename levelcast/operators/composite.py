"""Compositions of the engine's operators that applications use as one step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import draws
from . import aggregate, regress, sequence, sliding
from .project import crossed, rate_polynomial


def sliding_bandwidths(df: DataFrame, level: str, temp: str, t: str, by: Sequence[str], widths: Sequence[float] = (30.0, 40.0, 50.0, 60.0), **options) -> DataFrame:
    """``sliding.sliding_dynamic`` at each of a few half-widths (column ``bandwidth``)."""
    parts = [sliding.sliding_dynamic(df, level, temp, t, by, w, **options).withColumn("bandwidth", F.lit(float(w))) for w in widths]
    return reduce(DataFrame.unionByName, parts)


def sliding_grid(levels: DataFrame, forcings: DataFrame, t: str, level: str, temp: str, widths: Sequence[float], **options) -> DataFrame:
    """``sliding_bandwidths`` of every level series (``series``) against every forcing series (``forcing``) on common times, with their errors and
    second forcing where ``options`` name them."""
    more = lambda d, c: [options[c]] if options.get(c) in d.columns else []
    pairs = levels.select("series", t, level, *more(levels, "sigma")).join(forcings.select("forcing", t, temp, *more(forcings, "saod")), t)
    return sliding_bandwidths(pairs, level, temp, t, ["series", "forcing"], widths, **options)


def through_transfer(forcing: DataFrame, fit: DataFrame, temp: str, out: str, by: Sequence[str] = (), ids: DataFrame | None = None, t: str = "year", stream: str = "transfer") -> DataFrame:
    """A forcing put through a fitted line (``fit``: slope, intercept, their errors, resid_std; one row per ``by``).

    With sample ids, every sample has a line of its own, drawn from the errors, and independent
    residual noise at every time. The lines are as few as the series, the ids are crossed with the forcing.
    """
    lines = fit.select(*by, *[F.col(c).alias(f"_{c}") for c in ("slope", "intercept", "slope_se", "intercept_se", "resid_std")])
    joined = forcing.join(lines, list(by)) if by else forcing.crossJoin(F.broadcast(lines.limit(1)))
    slope, intercept, noise = F.col("_slope"), F.col("_intercept"), F.lit(0.0)
    if ids is not None:
        joined = ids.select("sample_id").crossJoin(joined)
        slope = slope + F.col("_slope_se") * draws.normal(f"{stream}/slope", "sample_id")
        intercept = intercept + F.col("_intercept_se") * draws.normal(f"{stream}/intercept", "sample_id")
        noise = F.col("_resid_std") * draws.normal(f"{stream}/noise", "sample_id", t)
    kept = [*(["sample_id"] if ids is not None else []), *forcing.columns]
    return joined.select(*kept, (slope * F.col(temp) + intercept + noise).alias(out))


def restricted(df: DataFrame, value: str, t: str, first: float, last: float, baseline: float, by: Sequence[str] = ()) -> DataFrame:
    """The rows of a span, both ends included, less the value of the row nearest to ``baseline``."""
    return sequence.rebased(df.filter(F.col(t).between(first, last)), value, t, baseline, by)


def restricted_fit(df: DataFrame, value: str, x: str, t: str, first: float, last: float, baseline: float, by: Sequence[str] = ()) -> DataFrame:
    """The line through a restricted and rebased series."""
    return regress.simple(restricted(df, value, t, first, last, baseline, by), value, x, by)


def headline(ensemble: DataFrame, years: Sequence[int], value: str = "value") -> DataFrame:
    """Of the totals of an ensemble (scenario, component, sample_id, year), at the given years: quantiles, the share of variance that scenarios differ by, and the scenarios' mean median."""
    few = ensemble.filter(F.col("year").isin(*years))
    total = aggregate.component_sum(few, value, ["scenario", "sample_id", "year"])
    q = aggregate.quantile_summary(total, value, ["scenario", "year"], {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    split = aggregate.total_variance(total, value, "scenario", ["year"]).select("year", (F.col("across") / F.col("total")).alias("scenario_share"))
    middle = q.groupBy("year").agg(F.avg("p50").alias("mean_median"))
    return q.join(split, "year").join(middle, "year").select("scenario", "year", "p05", "p50", "p95", "n", "scenario_share", "mean_median")


def gaussian_moments(quantiles: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and deviation of a sum of components, each taken as normal from p05, p50 and p95."""
    sigma = (F.col("p95") - F.col("p05")) / (2 * C.Z_90)
    return quantiles.groupBy(*by).agg(F.sum("p50").alias("mu"), F.sqrt(F.sum(sigma * sigma)).alias("sigma"))


def gaussian_combination(quantiles: DataFrame, samples: DataFrame, by: Sequence[str], value: str = "value", stream: str = "combined") -> DataFrame:
    """A component's samples plus the other components' sum, normal from their quantiles and independent of it."""
    moments = gaussian_moments(quantiles, by)
    z = draws.normal(stream, "sample_id", *by)
    return samples.join(moments, list(by)).select(*by, "sample_id", (F.col(value) + F.col("mu") + F.col("sigma") * z).alias(value))


def rate_envelope(parameters: DataFrame, temps: DataFrame, order: int = 2) -> DataFrame:
    """Quantiles over draws of the rate polynomial at each temperature of a short table, and the share of draws that bend up."""
    grid = crossed(parameters, temps).withColumn("rate", rate_polynomial(F.col("temp"), order))
    q = aggregate.quantile_summary(grid, "rate", ["temp"], {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    up = grid.groupBy("temp").agg(F.avg((F.col(f"c{order}") > 0).cast("double")).alias("p_convex"))
    return q.join(up, "temp").select("temp", "p05", "p50", "p95", "p_convex")


def median_curve(parameters: DataFrame, forcing: DataFrame, order: int = 2, t: str = "year") -> DataFrame:
    """The rate polynomial of the parameters' medians along a forcing."""
    middle = parameters.agg(*[F.median(f"c{k}").alias(f"c{k}") for k in range(order + 1)])
    return forcing.crossJoin(F.broadcast(middle)).select("scenario", t, rate_polynomial(F.col("temp"), order).alias("rate"))


def of_regions(parts: Mapping[str, DataFrame], dataset: str) -> DataFrame:
    """Tables of the same layout as one, with columns ``region`` and ``dataset``."""
    return reduce(DataFrame.unionByName, [df.withColumns({"region": F.lit(name), "dataset": F.lit(dataset)}) for name, df in parts.items()])


def square_kilometres(area: Column | str) -> Column:
    """Square metres to square kilometres."""
    return (F.col(area) if isinstance(area, str) else area) / 1e6
