"""Derived series: budget sums, standardised designs, prepared catalogues, extensions, crossovers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.scalars import quadrature
from . import sequence
from .regress import _grouped
from .resample import annual_mean, rebase_around

LAND_PARTS = ("reservoir", "groundwater", "tws_natural")


def thermodynamic_signal(df: DataFrame, total: str = "gmsl", parts: str = "sum_contributors") -> DataFrame:
    """Sums of a budget table with errors in quadrature.

    barystatic: glaciers + ice sheets + land water; sum_tws: the land terms; thermodynamic_total
    and thermodynamic_sum: the total, and the contributors' sum, without land water (the
    errors of a difference add up too).
    """
    s = lambda *names: quadrature(*[f"{n}_sigma" for n in names])
    mass = ("glaciers", "greenland", "antarctica", "tws")
    return df.withColumns(
        {
            "barystatic": sum((F.col(c) for c in mass[1:]), F.col(mass[0])), "barystatic_sigma": s(*mass),
            "sum_tws": sum((F.col(c) for c in LAND_PARTS[1:]), F.col(LAND_PARTS[0])), "sum_tws_sigma": s(*LAND_PARTS),
            "thermodynamic_total": F.col(total) - F.col("tws"), "thermodynamic_total_sigma": s(total, "tws"),
            "thermodynamic_sum": F.col(parts) - F.col("tws"), "thermodynamic_sum_sigma": s(parts, "tws"),
        }
    )


def standardised(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Columns less their mean over their population deviation (constants become zero), kept beside as ``<c>_mean`` and ``<c>_scale``."""
    w = Window.partitionBy(*by)
    for c in columns:
        df = df.withColumns({f"{c}_mean": F.avg(c).over(w), f"{c}_scale": F.stddev_pop(c).over(w)})
        df = df.withColumn(c, F.when(F.col(f"{c}_scale") > 0, (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_scale")).otherwise(0.0))
    return df


def unscaled(coefs: dict[str, float], means: dict[str, float], scales: dict[str, float], const: str = "const") -> dict[str, float]:
    """Coefficients of a standardised design as those of the original columns."""
    out = {k: v / scales[k] for k, v in coefs.items() if k != const}
    out[const] = coefs[const] - sum(out[k] * means[k] for k in out)
    return out


def prepared_series(df: DataFrame, value: str, t: str = "t_year", by: Sequence[str] = ("series",), start: float = 1950.0, baseline: float = 2000.0, window: float = 5.0, least: int = 10) -> DataFrame:
    """A catalogue of series: annual means, rebased around a year, from ``start`` on; series with fewer than ``least`` years are left out."""
    yearly = rebase_around(annual_mean(df, value, t, by), value, t, baseline, window, by).filter(F.col(t) >= start)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return yearly.withColumn("_n", n).filter(F.col("_n") >= least).drop("_n")


def extended(df: DataFrame, rates: DataFrame, value: str, sigma: str, rate: str, rate_sigma: str, t: str, by: Sequence[str]) -> DataFrame:
    """A cumulative series carried on past its end by the trapezoid of later rates, errors in quadrature."""
    last = df.groupBy(*by).agg(F.max_by(F.struct(F.col(t).alias("t"), F.col(value).alias("v"), F.col(sigma).alias("s")), t).alias("_l"))
    later = rates.join(F.broadcast(last), list(by)).filter(F.col(t) >= F.col("_l.t"))
    later = sequence.cumulative_trapezoid(later, rate, t, "_c", by)
    step = F.col(rate_sigma) * F.coalesce(F.col(t) - F.lag(t).over(sequence.ordered(t, by)), F.lit(0.0))
    later = later.withColumn("_e", step).withColumn("_q", F.sum(F.col("_e") * F.col("_e")).over(sequence.running(t, by)))
    new = later.filter(F.col(t) > F.col("_l.t")).select(*by, t, (F.col("_l.v") + F.col("_c")).alias(value), F.sqrt(F.col("_l.s") ** 2 + F.col("_q")).alias(sigma))
    return df.select(*by, t, value, sigma).unionByName(new)


def dual_response(forcing: DataFrame, temp: str, t: str, by: Sequence[str], a: Column | float, t0: Column | float, b: Column | float, baseline: float) -> DataFrame:
    """A semi-empirical alternative: dH/dt = a (T - T0) + b dT/dt, zero at the baseline."""
    df = sequence.gradient(forcing, temp, t, "_dt", by)
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return sequence.integrated_from(df.withColumn("_rate", lit(a) * (F.col(temp) - lit(t0)) + lit(b) * F.col("_dt")), "_rate", t, baseline, "level", 0.0, by).drop("_rate", "_dt")


def crossovers(df: DataFrame, left: str, right: str, t: str, by: Sequence[str]) -> DataFrame:
    """First time at which one curve passes the other, linear between rows; null if it never does."""
    w = sequence.ordered(t, by)
    d = F.col(left) - F.col(right)
    steps = df.withColumn("_d", d).withColumn("_p", F.lag("_d").over(w)).withColumn("_pt", F.lag(t).over(w))
    at = F.when((F.signum("_p") != F.signum("_d")) & F.col("_p").isNotNull(), F.col("_pt") + (F.col(t) - F.col("_pt")) * F.col("_p") / (F.col("_p") - F.col("_d")))
    return steps.groupBy(*by).agg(F.min(at).alias("crossing"))


def roughness(df: DataFrame, rate: str, t: str, by: Sequence[str]) -> DataFrame:
    """Largest and mean absolute change of a rate between rows: a blend should not add to it."""
    step = F.abs(sequence.difference(rate, sequence.ordered(t, by)))
    return df.withColumn("_s", step).groupBy(*by).agg(F.max("_s").alias("most"), F.avg("_s").alias("mean"))


def degree_probabilities(df: DataFrame, y: str, t: str, by: Sequence[str], degrees: Sequence[int] = (1, 2, 3), sigma: str | None = None) -> DataFrame:
    """Probabilities of polynomial degrees from BIC weights."""

    def fit(pdf: pd.DataFrame) -> dict:
        pdf = pdf.dropna()
        x = pdf[t].to_numpy(float)
        x = (x - x.mean()) / max(float(np.ptp(x)), 1e-12)
        w = None if sigma is None else 1 / pdf[sigma].to_numpy(float) ** 2
        bic = np.array([stats.Fit(np.vander(x, d + 1), pdf[y].to_numpy(float), w).bic for d in degrees])
        p = np.exp(-0.5 * (bic - bic.min()))
        return {"degree": list(degrees), "bic": bic, "probability": p / p.sum()}

    return _grouped(df, by, list(dict.fromkeys([t, y, *([sigma] if sigma else [])])), fit, "degree int, bic double, probability double")


def leave_future_out(df: DataFrame, y: str, t: str, by: Sequence[str], ends: DataFrame, degree: int = 2, horizon: float = 10.0, least: int = 8) -> DataFrame:
    """Polynomials fitted up to each of a few ``end`` times, judged on the rows of the horizon after it.

    Rows (by..., end, n, bias, rmse, log_score); ends with too few rows on either side are left out.
    """
    grid = df.crossJoin(F.broadcast(ends)).filter(F.col(t) <= F.col("end") + horizon)

    def fit(pdf: pd.DataFrame) -> dict:
        pdf = pdf.dropna()
        end = float(pdf["_end"].iloc[0]) if len(pdf) else 0.0
        past, future = pdf[pdf[t] <= end], pdf[pdf[t] > end]
        if len(past) < least or not len(future):
            return {c: [] for c in ("n", "bias", "rmse", "log_score")}
        x = lambda d: np.vander(d[t].to_numpy(float) - end, degree + 1)
        f = stats.Fit(x(past), past[y].to_numpy(float))
        mean = x(future) @ f.coef
        var = f.scale + np.einsum("ij,jk,ik->i", x(future), f.cov, x(future))
        r = future[y].to_numpy(float) - mean
        score = float((-0.5 * np.log(2 * np.pi * var) - 0.5 * r**2 / var).mean())
        return {"n": [len(future)], "bias": -r.mean(), "rmse": np.sqrt((r**2).mean()), "log_score": score}

    return _grouped(grid.withColumn("_end", F.col("end")), [*by, "end"], [t, y, "_end"], fit, "n long, bias double, rmse double, log_score double")


def skew_normal_agreement(df: DataFrame, loc: str, scale: str, alpha: str, quantiles: Sequence[tuple[float, str]]) -> DataFrame:
    """Largest difference between a fitted skew-normal's distribution function and given quantiles (column ``worst``)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        for pdf in batches:
            worst = [max(abs(stats.skew_normal_cdf((r[c] - r[loc]) / r[scale], r[alpha]) - p) for p, c in quantiles) for r in pdf.to_dict("records")]
            yield pdf.assign(worst=worst)

    return df.mapInPandas(run, fields + ", worst double")
