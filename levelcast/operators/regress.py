"""Regressions of series: least squares, robust errors, dynamic regressions, model choice, delays.

A series, or a pair of series, is small; there may be many. Features are made in Spark by
windows; each group's rows meet in one grouped function that solves the system in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import sequence
from .align import nearest


def _fields(df: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)


def _grouped(df: DataFrame, by: Sequence[str], columns: Sequence[str], fit, schema: str) -> DataFrame:
    """``fit`` on each group's rows; its rows get the group's key."""
    keys = list(by)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(fit(pdf))
        for name, value in zip(keys, key, strict=True):
            out.insert(0, name, value)
        return out

    return df.select(*keys, *columns).groupBy(*keys).applyInPandas(run, _fields(df, keys) + schema)


TERMS = "term string, coef double, se double, n long, r2 double, aic double, bic double, scale double"


def _terms(fit: stats.Fit, names: Sequence[str]) -> dict:
    return {"term": list(names), "coef": fit.coef, "se": fit.se, "n": fit.n, "r2": fit.r2, "aic": fit.aic, "bic": fit.bic, "scale": fit.scale}


def linear(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str], weight: str | None = None, lags: int | None = None) -> DataFrame:
    """Weighted least squares per group with an intercept (term ``const``, last); HAC errors if ``lags``."""
    xs = list(xs)

    def fit(pdf: pd.DataFrame) -> dict:
        pdf = pdf.dropna()
        x = np.column_stack([pdf[xs].to_numpy(float), np.ones(len(pdf))])
        return _terms(stats.Fit(x, pdf[y].to_numpy(float), None if weight is None else pdf[weight].to_numpy(float), lags), [*xs, "const"])

    return _grouped(df, by, list(dict.fromkeys([y, *xs, *([weight] if weight else [])])), fit, TERMS)


def simple(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Straight line per group, in SQL aggregates alone: slope, intercept, their errors, r, residual deviation."""
    g = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_avgx(y, x).alias("_mx"), F.regr_count(y, x).alias("n"))
    ssr = F.col("_syy") * (1 - F.col("r2"))
    s2 = ssr / (F.col("n") - 2)
    return g.select(*by, "slope", "intercept", F.sqrt(s2 / F.col("_sxx")).alias("slope_se"), F.sqrt(s2 * (1 / F.col("n") + F.col("_mx") ** 2 / F.col("_sxx"))).alias("intercept_se"), (F.signum("slope") * F.sqrt("r2")).alias("r"), F.sqrt(ssr / F.col("n")).alias("resid_std"), "n")


def dynamic_design(df: DataFrame, temp: str, t: str, order: int = 2, n_lags: int = 2, saod: str | None = None, by: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Design of a dynamic least-squares regression of a level on integrals of a forcing's powers.

    Columns: integrals of temp^order..temp^1, the trend, the integral of a second forcing,
    leads and lags -n..n of the changes of both. Rows at the ends, whose leads or lags are
    missing, are dropped. Returns the design and the names of its columns, in that order.
    """
    if order not in (1, 2, 3):
        raise ValueError("order must be 1, 2 or 3")
    df = sequence.cumulative_powers(df, temp, t, order, by)
    first = F.min(t).over(sequence.Window.partitionBy(*by))
    df = df.withColumn("trend", F.col(t) - first)
    names = [f"cum_t{k}" for k in range(order, 0, -1)] + ["trend"]
    changes = [("dt", temp)]
    if saod:
        df = sequence.cumulative_trapezoid(df, saod, t, "cum_saod", by)
        names.append("cum_saod")
        changes.append(("ds", saod))
    for prefix, column in changes:
        df = df.withColumn(f"_{prefix}", sequence.difference(column, sequence.ordered(t, by), 0.0))
    for prefix, _ in changes:
        if n_lags:
            df = sequence.leads_and_lags(df, f"_{prefix}", t, n_lags, by, prefix)
            names += [f"{prefix}_{'m' if k < 0 else 'p'}{abs(k)}" for k in range(-n_lags, n_lags + 1)]
    return df, names


def calibrate_dynamic(df: DataFrame, level: str, temp: str, t: str, by: Sequence[str], sigma: str | None = None, saod: str | None = None, order: int = 2, n_lags: int = 2, lags: int | None = None) -> DataFrame:
    """Dynamic least squares per group with HAC errors (lags by the Newey-West rule unless given).

    The rate is a polynomial of the forcing: its coefficients are those of the integrals and
    the trend.
    """
    design, names = dynamic_design(df, temp, t, order, n_lags, saod, by)

    def fit(pdf: pd.DataFrame) -> dict:
        pdf = pdf.dropna()
        x = np.column_stack([pdf[names].to_numpy(float), np.ones(len(pdf))])
        w = None if sigma is None else 1 / pdf[sigma].to_numpy(float) ** 2
        return _terms(stats.Fit(x, pdf[level].to_numpy(float), w, stats.hac_lags(len(pdf)) if lags is None else lags), [*names, "const"])

    return _grouped(design, by, list(dict.fromkeys([level, *names, *([sigma] if sigma else [])])), fit, TERMS)


def robustness_matrix(levels: DataFrame, forcings: DataFrame, t: str, level: str, temp: str, order: int = 2, n_lags: int = 2) -> DataFrame:
    """Every level series (``series``) against every forcing series (``forcing``) on common years.

    Pairs with fewer than 10 + 2 n_lags common times are left out.
    """
    pairs = levels.select("series", t, level).join(forcings.select("forcing", t, temp), t)
    enough = pairs.groupBy("series", "forcing").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 10 + 2 * n_lags).drop("_n")
    return calibrate_dynamic(pairs.join(enough, ["series", "forcing"], "left_semi"), level, temp, t, ["series", "forcing"], order=order, n_lags=n_lags)


def nonlinearity(df: DataFrame, rate: str, temp: str, by: Sequence[str], sigma: str | None = None) -> DataFrame:
    """Rate against temperature as polynomials of degree 1, 2, 3: nested F tests, AIC, BIC, a recommended degree.

    A degree gets a vote from each criterion that prefers it; F at the 5 % level.
    """

    def fit(pdf: pd.DataFrame) -> dict:
        pdf = pdf.dropna()
        x, y = pdf[temp].to_numpy(float), pdf[rate].to_numpy(float)
        w = None if sigma is None else 1 / pdf[sigma].to_numpy(float) ** 2
        fits = [stats.Fit(np.vander(x, d + 1), y, w, stats.hac_lags(len(y))) for d in (1, 2, 3)]
        ps = [math.nan]
        for a, b in zip(fits, fits[1:], strict=False):
            f = (a.ssr - b.ssr) / (b.ssr / max(1, b.n - b.k)) if b.ssr > 0 else math.inf
            ps.append(stats.f_p_value(f, 1, max(1, b.n - b.k)))
        by_f = 3 if ps[2] < 0.05 and ps[1] < 0.05 else 2 if ps[1] < 0.05 else 1
        votes = [by_f, 1 + int(np.argmin([f.aic for f in fits])), 1 + int(np.argmin([f.bic for f in fits]))]
        best = max(sorted(set(votes)), key=votes.count)
        return {"degree": [1, 2, 3], "r2": [f.r2 for f in fits], "aic": [f.aic for f in fits], "bic": [f.bic for f in fits], "f_p": ps, "recommended": best}

    return _grouped(df, by, list(dict.fromkeys([rate, temp, *([sigma] if sigma else [])])), fit, "degree int, r2 double, aic double, bic double, f_p double, recommended int")


def second_forcing_test(df: DataFrame, level: str, temp: str, saod: str, t: str, by: Sequence[str], order: int = 2, n_lags: int = 2) -> DataFrame:
    """Dynamic regressions with and without a second forcing on the same rows: F, t, AIC and BIC differences.

    A criterion decides where it differs by more than 2.
    """
    design, names = dynamic_design(df, temp, t, order, n_lags, saod, by)
    fewer = [n for n in names if n != "cum_saod" and not n.startswith("ds_")]

    def fit(pdf: pd.DataFrame) -> dict:
        pdf = pdf.dropna()
        y, one, lags = pdf[level].to_numpy(float), np.ones(len(pdf)), stats.hac_lags(len(pdf))
        a = stats.Fit(np.column_stack([pdf[fewer].to_numpy(float), one]), y, None, lags)
        b = stats.Fit(np.column_stack([pdf[names].to_numpy(float), one]), y, None, lags)
        i, more = names.index("cum_saod"), b.k - a.k
        f = (a.ssr - b.ssr) / more / (b.ssr / max(1, b.n - b.k))
        d_aic, d_bic = b.aic - a.aic, b.bic - a.bic
        verdict = ["include" if d < -2 else "exclude" if d > 2 else "undecided" for d in (d_aic, d_bic)]
        return {"f": [f], "f_p": stats.f_p_value(f, more, max(1, b.n - b.k)), "t": b.coef[i] / b.se[i], "d_aic": d_aic, "d_bic": d_bic, "by_aic": verdict[0], "by_bic": verdict[1]}

    return _grouped(design, by, [level, *names], fit, "f double, f_p double, t double, d_aic double, d_bic double, by_aic string, by_bic string")


def quadratic_fit(df: DataFrame, t: str, level: str, by: Sequence[str], at: float, mode: str = "hac", sigma: str | None = None, inflate: float = 1.0, drift: float = 1.5e-4) -> DataFrame:
    """Level, rate and acceleration at a time, with the 2 x 2 covariance of the last two.

    Modes: ``wls`` weighs by sigma; ``hac`` has robust errors with ceil(sqrt(n)) lags; ``budget``
    inflates plain errors for autocorrelation, (1 + rho) / (1 - rho), and adds a drift error
    to the rate. Fewer than five points are an error.
    """
    if mode not in ("wls", "hac", "budget"):
        raise ValueError(f"unknown mode {mode!r}")

    def fit(pdf: pd.DataFrame) -> dict:
        pdf = pdf.dropna()
        if len(pdf) < 5:
            raise ValueError("a quadratic needs at least five points")
        pdf = pdf.sort_values(t)
        d = pdf[t].to_numpy(float) - at
        x = np.column_stack([np.ones(len(d)), d, d * d])
        w = 1 / (pdf[sigma].to_numpy(float) * inflate) ** 2 if sigma and mode != "hac" else None
        f = stats.Fit(x, pdf[level].to_numpy(float), w, math.ceil(math.sqrt(len(d))) if mode == "hac" else None)
        cov = f.cov[1:, 1:] * np.array([[1, 2], [2, 4]])
        if mode == "budget":
            rho = stats.ar1(f.resid)
            cov = cov * max(1.0, (1 + rho) / (1 - rho))
            cov[0, 0] += drift**2
        return {"level": [f.coef[0]], "rate": f.coef[1], "accel": 2 * f.coef[2], "var_rate": cov[0, 0], "cov_rate_accel": cov[0, 1], "var_accel": cov[1, 1], "n": f.n, "r2": f.r2}

    return _grouped(df, by, list(dict.fromkeys([t, level, *([sigma] if sigma else [])])), fit, "level double, rate double, accel double, var_rate double, cov_rate_accel double, var_accel double, n long, r2 double")


def transfer(df: DataFrame, other: DataFrame, x: str, y: str, t: str, by: Sequence[str] = (), tolerance: float = 0.5, lag: float = 0.0, least: int = 5) -> DataFrame:
    """y = slope x + intercept on pairs matched to the nearest time, x leading by ``lag``.

    Fewer than ``least`` pairs are an error.
    """
    shifted = df.withColumn(t, F.col(t) - lag)
    pairs = nearest(shifted, other, t, [x], by, tolerance).withColumnRenamed(f"near_{x}", "_x")
    out = simple(pairs, y, "_x", by)
    return out.withColumn("slope", F.when(F.col("n") >= least, F.col("slope")).otherwise(F.raise_error(F.lit(f"fewer than {least} pairs")).cast("double")))


def model_selection(df: DataFrame, t: str, level: str, temp: str, by: Sequence[str]) -> DataFrame:
    """Rates between neighbours against mid temperatures, linear or quadratic: R2, AIC, BIC, F, t and four votes."""
    rates = sequence.midpoint_rates(df, level, t, by, also=[temp])

    def fit(pdf: pd.DataFrame) -> dict:
        pdf = pdf.dropna()
        x, y = pdf[f"mid_{temp}"].to_numpy(float), pdf["rate"].to_numpy(float)
        n = len(y)
        fits = [stats.Fit(np.vander(x, d + 1), y) for d in (1, 2)]
        aic = [n * math.log(max(f.ssr, 1e-300) / n) + 2 * f.k for f in fits]
        bic = [n * math.log(max(f.ssr, 1e-300) / n) + f.k * math.log(n) for f in fits]
        f_stat = (fits[0].ssr - fits[1].ssr) / (fits[1].ssr / max(1, n - 3)) if fits[1].ssr > 0 else math.inf
        t_stat = fits[1].coef[0] / fits[1].se[0] if fits[1].se[0] > 0 else math.inf
        votes = int(aic[1] < aic[0]) + int(bic[1] < bic[0]) + int(stats.f_p_value(f_stat, 1, max(1, n - 3)) < 0.05) + int(stats.t_p_value(t_stat, max(1, n - 3)) < 0.05)
        return {"r2_linear": [fits[0].r2], "r2_quadratic": fits[1].r2, "d_aic": aic[1] - aic[0], "d_bic": bic[1] - bic[0], "f": f_stat, "t": t_stat, "votes": votes, "recommended": "quadratic" if votes >= 3 else "linear"}

    return _grouped(rates, by, ["rate", f"mid_{temp}"], fit, "r2_linear double, r2_quadratic double, d_aic double, d_bic double, f double, t double, votes int, recommended string")


def power_analysis(df: DataFrame, coef: str, se: str, n: str, reference: float) -> DataFrame:
    """Smallest detectable effect at 80 % power, whether the interval excludes ``reference``, and the power for it."""

    def run(batches):
        for pdf in batches:
            dof = (pdf[n] - 3).clip(lower=1)
            crit = np.array([stats.t_quantile(0.975, d) for d in dof])
            shift = (pdf[coef] - reference).abs() / pdf[se]
            yield pdf.assign(mde=(crit + 0.8416212335729143) * pdf[se], differs=shift > crit, power=[1 - stats.t_cdf(c - s, d) + stats.t_cdf(-c - s, d) for c, s, d in zip(crit, shift, dof, strict=True)])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, fields + ", mde double, differs boolean, power double")


def delay_model(df: DataFrame, forcing: DataFrame, t: str, level: str, sigma: str, temp: str, delays: DataFrame, by: Sequence[str], n_samples: int = 2000, seed: int = 0, rate_window: float = 10.0, rate_weight: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """H = gamma * integral of T(t - delay) + r0 * t + h0 for each candidate delay.

    A pseudo-observation ties the modelled mean rate of the last ``rate_window`` years to the
    observed one. Returns the fits (gamma, r0, their errors, BIC = 2 ln n - 2 loglik, weight)
    and ``n_samples`` draws per group, dealt to the delays by BIC weight, the rest to the best.
    """
    from .align import lagged_interpolate

    lags = delays.select(F.col("delay").alias("lag"))
    at = lagged_interpolate(df.select(*by, t, level, sigma), forcing.select(*by, t, temp), lags, t, [temp], by)
    at = sequence.cumulative_trapezoid(at, temp, t, "integral", [*by, "lag"]).withColumnRenamed("lag", "delay")

    def fit(pdf: pd.DataFrame) -> dict:
        pdf = pdf.dropna().sort_values(t)
        year, x, y, s = (pdf[c].to_numpy(float) for c in (t, "integral", level, sigma))
        w = 1 / s**2
        mid = lambda v: v - (w * v).sum() / w.sum()
        a = np.column_stack([mid(x), mid(year)])
        b = mid(y)
        last = year >= year.max() - rate_window
        if last.sum() > 2 and rate_weight > 0:
            span = year[last] - year[last].mean()
            rates = [float((span * v[last]).sum() / (span**2).sum()) for v in (x, y)]
            err = s[last].mean() / math.sqrt(float((span**2).sum()))
            a, b, w = np.vstack([a, [rates[0], 1.0]]), np.append(b, rates[1]), np.append(w, rate_weight / err**2)
        f = stats.Fit(a, b, w)
        n = len(y)
        loglik = -0.5 * float((w[:n] * f.resid[:n] ** 2).sum()) - float(np.log(s).sum()) - n / 2 * math.log(2 * math.pi)
        cov = np.linalg.pinv((a * w[:, None]).T @ a)
        return {"gamma": [f.coef[0]], "r0": f.coef[1], "var_gamma": cov[0, 0], "cov_gamma_r0": cov[0, 1], "var_r0": cov[1, 1], "bic": 2 * math.log(n) - 2 * loglik, "n": n}

    fits = _grouped(at, [*by, "delay"], [t, "integral", level, sigma], fit, "gamma double, r0 double, var_gamma double, cov_gamma_r0 double, var_r0 double, bic double, n long")
    w = sequence.Window.partitionBy(*by)
    raw = F.exp(-0.5 * (F.col("bic") - F.min("bic").over(w)))
    fits = fits.withColumn("_e", raw).withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_e")
    dealt = fits.withColumn("_m", F.round(F.col("weight") * n_samples).cast("int")).withColumn("_best", F.row_number().over(w.orderBy(F.desc("weight"), "delay")) == 1)
    dealt = dealt.withColumn("_m", F.when(F.col("_best"), n_samples - F.sum("_m").over(w) + F.col("_m")).otherwise(F.col("_m"))).withColumn("_from", F.sum("_m").over(w.orderBy("delay").rowsBetween(sequence.Window.unboundedPreceding, -1)))
    rows = dealt.filter("_m > 0").withColumn("sample_id", F.explode(F.sequence(F.coalesce("_from", F.lit(0)), F.coalesce("_from", F.lit(0)) + F.col("_m") - 1)))
    from ..functions import draws

    z1, z2 = (draws.normal(f"delay/{seed}/{k}", *by, "sample_id") for k in (1, 2))
    root = F.sqrt("var_gamma")
    slope = F.when(root > 0, F.col("cov_gamma_r0") / root).otherwise(0.0)
    rest = F.sqrt(F.greatest(F.col("var_r0") - slope * slope, F.lit(0.0)))
    samples = rows.select(*by, "sample_id", "delay", (F.col("gamma") + root * z1).alias("gamma"), (F.col("r0") + slope * z1 + rest * z2).alias("r0"))
    return fits, samples


def skew_normal_fit(df: DataFrame, by: Sequence[str], quantiles: Sequence[tuple[float, str]]) -> DataFrame:
    """Location, scale and shape of a skew-normal through given quantiles (columns), by least squares on a shape grid.

    For a shape, location and scale are a straight line through the standard quantiles, so the
    search is over the shape alone, refined about the best.
    """
    names = [c for _, c in quantiles]
    probs = [p for p, _ in quantiles]

    def fit(pdf: pd.DataFrame) -> dict:
        y = pdf[names].iloc[0].to_numpy(float)

        def loss(alpha: float) -> tuple[float, float, float]:
            z = np.array([stats.skew_normal_quantile(p, alpha) for p in probs])
            a = np.column_stack([np.ones(len(z)), z])
            (loc, scale), *_ = np.linalg.lstsq(a, y, rcond=None)
            return float(((a @ [loc, scale] - y) ** 2).sum()), float(loc), float(scale)

        best, width = 0.0, 10.0
        for _ in range(6):
            grid = best + width * np.linspace(-1, 1, 17)
            best = float(min(grid, key=lambda g: loss(g)[0]))
            width /= 8
        sse, loc, scale = loss(best)
        return {"loc": [loc], "scale": scale, "alpha": best, "rmse": math.sqrt(sse / len(y))}

    return _grouped(df, by, names, fit, "loc double, scale double, alpha double, rmse double")


def budget_target(total: DataFrame, parts: DataFrame, t: str, value: str, sigma: str, by: Sequence[str] = ()) -> DataFrame:
    """What is left of a total after the parts (interpolated to its times, null counts as zero), errors in quadrature."""
    from .align import interpolate

    names = parts.select("component").distinct()
    asked = total.select(*by, t, F.col(value).alias("_v"), F.col(sigma).alias("_s")).crossJoin(F.broadcast(names))
    at = interpolate(asked, parts.select(*by, "component", t, value, sigma), t, [value, sigma], [*by, "component"], "null")
    g = at.groupBy(*by, t, "_v", "_s").agg(F.sum(F.coalesce(value, F.lit(0.0))).alias("_p"), F.sum(F.coalesce(F.col(sigma) ** 2, F.lit(0.0))).alias("_q"))
    return g.select(*by, t, (F.col("_v") - F.col("_p")).alias(value), F.sqrt(F.col("_s") ** 2 + F.col("_q")).alias(sigma))
