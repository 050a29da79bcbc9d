"""Scenario mixtures of an unstable component: endpoints, coherent paths, sensitivities.

All draws are hashes of the sample id, so every path is one expression of its own id and year.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import draws

#: name -> (weight, 5th and 95th percentile in mm, shape, exponent's log-location and log-scale)
Scenarios = Mapping[str, tuple[float, float, float, float, float, float]]


def overridden(scenarios: Scenarios, weights: Mapping[str, float] | None = None, **changes: tuple[str, int, float]) -> dict:
    """Scenarios with other weights (renormalised) or with one parameter of one scenario changed.

    changes: any name -> (scenario, position, value).
    """
    out = {k: list(v) for k, v in scenarios.items()}
    for name, w in (weights or {}).items():
        out[name][0] = w
    for scenario, at, value in changes.values():
        out[scenario][at] = value
    total = sum(v[0] for v in out.values())
    return {k: (v[0] / total, *v[1:]) for k, v in out.items()}


def tornado_weight(scenarios: Scenarios, name: str, delta: float) -> dict:
    """One weight moved by ``delta`` within [0.01, 0.95]; the others keep their ratios."""
    p = scenarios[name][0]
    moved = min(max(p + delta, 0.01), 0.95)
    return {k: ((moved if k == name else v[0] * (1 - moved) / (1 - p)), *v[1:]) for k, v in scenarios.items()}


def sample_ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("sample_id"))


def endpoints(ids: DataFrame, scenarios: Scenarios = C.INSTABILITY, mode: str = "A", stream: str = "mix") -> DataFrame:
    """Per sample: its scenario (``branch``), the level at the horizon in mm (``end_mm``) and its path's exponent (``beta``).

    Mode A corrects the endpoint by N(1.28, 0.07) of at least 1, and the exponent by an
    independent draw; mode B derives both from one draw of the flow exponent.
    """
    if mode not in ("A", "B"):
        raise ValueError(f"unknown mode {mode!r}")
    names = list(scenarios)
    out = ids.withColumn("_k", draws.choice(f"{stream}/branch", "sample_id", weights=[scenarios[s][0] for s in names]))
    n = F.greatest(draws.normal(f"{stream}/n", "sample_id", mean=C.EXPONENT_MEAN, sigma=C.EXPONENT_SIGMA), F.lit(C.EXPONENT_REF))
    if mode == "A":
        factor = F.greatest(draws.normal(f"{stream}/rheology", "sample_id", mean=C.RHEOLOGY_MEAN, sigma=C.RHEOLOGY_SIGMA), F.lit(1.0))
    else:
        factor = F.greatest(1 + C.RHEOLOGY_SLOPE * (n - C.EXPONENT_REF), F.lit(1.0))
    branch, end, beta = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(1.0)
    for i, s in enumerate(names):
        _, low, high, alpha, loc, scale = scenarios[s]
        is_s = F.col("_k") == i
        branch = F.when(is_s, s).otherwise(branch)
        end = F.when(is_s, draws.log_skew_normal(f"{stream}/{s}", "sample_id", low=low, high=high, alpha=alpha)).otherwise(end)
        if scale > 0:
            beta = F.when(is_s, draws.lognormal(f"{stream}/{s}/beta", "sample_id", mu=loc, sigma=scale) * (n + 1) / (C.EXPONENT_REF + 1)).otherwise(beta)
    return out.select("sample_id", branch.alias("branch"), (end * factor).alias("end_mm"), beta.alias("beta"))


def _path(year: Column, anchor_year: float, anchor: Column) -> Column:
    part = (year - anchor_year) / (2100 - anchor_year)
    return (anchor + F.greatest(F.col("end_mm") - anchor, F.lit(0.0)) * F.pow(part, F.col("beta"))) / 1000


def at_year(ids: DataFrame, year: float, anchor_mm: float = 0.0, anchor_sigma: float = 0.0, anchor_year: float = C.ONSET_YEAR, observed: tuple[float, float] | None = None, stream: str = "mix", **options) -> DataFrame:
    """Levels in metres of one year; up to the anchor year the observation with its error."""
    ends = endpoints(ids, stream=stream, **options)
    anchor = draws.normal(f"{stream}/anchor", "sample_id", mean=anchor_mm, sigma=anchor_sigma)
    if year <= anchor_year:
        mean, sigma = observed or (anchor_mm, 0.0)
        return ends.withColumn("value", draws.normal(f"{stream}/observed", "sample_id", mean=mean, sigma=sigma) / 1000)
    return ends.withColumn("value", _path(F.lit(float(year)), anchor_year, anchor))


def trajectories(ids: DataFrame, years: DataFrame, anchor_mm: float = 0.0, anchor_sigma: float = 0.0, anchor_year: float = C.ONSET_YEAR, observed: DataFrame | None = None, stream: str = "mix", **options) -> DataFrame:
    """(sample_id, year, value, branch): coherent paths in metres.

    Zero before the observations (year, mm, sigma), the observation and its noise up to the
    anchor year, then the power law of each sample, also beyond the horizon.
    """
    ends = endpoints(ids, stream=stream, **options)
    anchor = draws.normal(f"{stream}/anchor", "sample_id", mean=anchor_mm, sigma=anchor_sigma)
    grid = ends.withColumn("_anchor", anchor).crossJoin(F.broadcast(years))
    if observed is None:
        before = F.when(F.col("year") < anchor_year, 0.0).otherwise(F.lit(anchor_mm / 1000))
    else:
        from .align import interpolate

        first = observed.agg(F.min("year").alias("_first"))
        at = interpolate(years, observed.select(F.col("year").cast("double").alias("year"), "mm", "sigma"), "year", ["mm", "sigma"], outside="null")
        grid = grid.join(F.broadcast(at), "year").crossJoin(F.broadcast(first))
        noise = draws.normal(f"{stream}/observed", "sample_id", "year")
        before = F.when(F.col("year") < F.col("_first"), 0.0).otherwise((F.coalesce("mm", F.lit(0.0)) + F.coalesce("sigma", F.lit(0.0)) * noise) / 1000)
    value = F.when(F.col("year") <= anchor_year, before).otherwise(_path(F.col("year"), anchor_year, F.col("_anchor")))
    return grid.select("sample_id", "year", value.alias("value"), "branch")


def sensitivity(ids: DataFrame, variants: Mapping[str, Scenarios], year: float, quantiles: Sequence[float] = (0.05, 0.5, 0.95), **options) -> DataFrame:
    """Quantiles of a year under each named variant of the scenarios."""
    from .aggregate import quantile_summary

    each = [at_year(ids, year, scenarios=s, **options).select(F.lit(name).alias("variant"), "value") for name, s in variants.items()]
    names = {f"p{round(p * 100):02d}": p for p in quantiles}
    return quantile_summary(reduce(DataFrame.unionByName, each), "value", ["variant"], names).select("variant", *names)


def common_draws(df: DataFrame, sample: str, n: int, by: Sequence[str] = (), stream: str = "thin") -> DataFrame:
    """The ``n`` samples with the smallest hashes, renumbered from 0; the same for every group of ``by``."""
    from pyspark.sql import Window

    order = [F.xxhash64(F.lit(stream), F.col(sample)), F.col(sample)]
    few = df.select(sample).distinct().orderBy(*order).limit(n)
    few = few.withColumn("_new", F.row_number().over(Window.orderBy(*order)) - 1)
    return df.join(F.broadcast(few), sample).withColumn(sample, F.col("_new")).drop("_new")
