"""Scalar expressions: Spark columns in, a Spark column out; all stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value where it is a finite number, else null."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def null_if_at_most(c: Column | str, sentinel: float) -> Column:
    """Null for values at or below a missing-data mark such as -999 or -99."""
    c = col(c)
    return F.when(c <= sentinel, None).otherwise(c)


def null_if_equal(c: Column | str, sentinel: float, tolerance: float = 1e-6) -> Column:
    """Null for values equal to a mark such as -999.999."""
    c = col(c)
    return F.when(F.abs(c - sentinel) <= tolerance, None).otherwise(c)


def null_if_huge(c: Column | str, most: float = 1e20) -> Column:
    """Null for fill values whose magnitude exceeds ``most``."""
    c = col(c)
    return F.when(F.abs(c) > most, None).otherwise(c)


def sigma_from_interval(low: Column | str, high: Column | str, z: float = C.Z_90) -> Column:
    """Standard deviation of a symmetric interval of +-z."""
    return (col(high) - col(low)) / (2 * z)


def sigma_from_half_width(width: Column | str, z: float = C.Z_95) -> Column:
    return col(width) / z


def quadrature(*sigmas: Column | str) -> Column:
    """Root of the sum of squares."""
    total = F.lit(0.0)
    for s in sigmas:
        total = total + col(s) * col(s)
    return F.sqrt(total)


def mass_to_level(gigatonnes: Column | str) -> Column:
    """Gigatonnes of mass gained to metres of level: mass lost raises the level."""
    return -col(gigatonnes) * C.GT_TO_M


def optical_depth(transmission: Column | str) -> Column:
    return -F.log(col(transmission))


def sigma_taper(sigma: Column | str, year: Column | str, first: Column | float, t_ref: float, f_max: float) -> Column:
    """Sigma times a factor that falls from ``f_max`` at ``first`` to 1 at ``t_ref``; unchanged where that makes no sense."""
    first = first if isinstance(first, Column) else F.lit(float(first))
    factor = 1 + (f_max - 1) * (t_ref - col(year)) / (t_ref - first)
    use = (F.lit(f_max) > 1) & (F.lit(t_ref) > first) & (col(year) < t_ref)
    return F.when(use, col(sigma) * factor).otherwise(col(sigma))


def sigma_inflated(sigma: Column | str, year: Column | str, start: float, end: float, extra: float) -> Column:
    """Extra error in quadrature within an era."""
    return F.when(col(year).between(start, end), F.sqrt(col(sigma) ** 2 + extra**2)).otherwise(col(sigma))


def capped(value: Column | str, cap: float = 0.32) -> Column:
    return F.least(col(value), F.lit(cap))


def people_displaced(level: Column | str) -> Column:
    """Millions of people displaced by a level in metres (quadratic fit)."""
    x = col(level)
    return 17.03 * x * x + 145 * x + 260


def piecewise_linear(x: Column | str, knots: Sequence[float], values: Sequence[float], extrapolate: bool = True) -> Column:
    """Linear between knots, ``values[0]`` below the first; beyond the last the last slope, or its value."""
    x = col(x)
    slope = (values[-1] - values[-2]) / (knots[-1] - knots[-2])
    out = F.lit(float(values[-1])) + (slope * (x - knots[-1]) if extrapolate else F.lit(0.0))
    for i in range(len(knots) - 2, -1, -1):
        s = (values[i + 1] - values[i]) / (knots[i + 1] - knots[i])
        out = F.when(x <= knots[i + 1], values[i] + s * (x - knots[i])).otherwise(out)
    return F.when(x < knots[0], float(values[0])).otherwise(out)


def damage(level: Column | str) -> Column:
    """Annual cost (billion dollars) of a level: zero below zero, linear beyond the last knot."""
    return piecewise_linear(level, C.DAMAGE_KNOTS_M, C.DAMAGE_KNOTS_BUSD)


def annuity(arrival: Column | str, target: Column | str, rate: float = C.DISCOUNT) -> Column:
    """Present value of one unit a year from ``arrival`` to ``target``; zero if there is no time between."""
    years = col(target) - col(arrival)
    return F.when(years <= 0, 0.0).otherwise((1 - F.pow(F.lit(1 + rate), -years)) / rate)


def capital_recovery(rate: float = C.DISCOUNT, years: int = C.HORIZON_YEARS) -> float:
    """Annual payment that repays one unit over ``years``."""
    growth = (1 + rate) ** years
    return rate * growth / (growth - 1)


def fading_weight(year: Column | str, centre: float, tau: float) -> Column:
    """Falls from 1 to 0 about ``centre``."""
    return 1 / (1 + F.exp((col(year) - centre) / tau))


def kernel(u: Column | str, name: str = "tricube") -> Column:
    """Weight of a scaled distance: tricube, epanechnikov, parabola (0 beyond 1) or gaussian."""
    u = col(u)
    if name == "gaussian":
        return F.exp(-u * u / 2)
    forms = {"tricube": F.pow(1 - F.pow(F.abs(u), 3), 3), "epanechnikov": 0.75 * (1 - u * u), "parabola": 1 - u * u}
    if name not in forms:
        raise ValueError(f"unknown kernel {name!r}")
    return F.when(F.abs(u) <= 1, forms[name]).otherwise(0.0)


def polynomial(x: Column | str, coefficients: Sequence[Column | float]) -> Column:
    """Horner's scheme; ``coefficients`` from the highest power down."""
    x, out = col(x), None
    for c in coefficients:
        c = c if isinstance(c, Column) else F.lit(float(c))
        out = c if out is None else out * x + c
    return out


def rate_band(x: Column | str, coef: Sequence[float], cov: Sequence[Sequence[float]], z: float = C.Z_95) -> tuple[Column, Column, Column]:
    """Polynomial rate and its delta-method interval (coefficients from the highest power down)."""
    x, p = col(x), len(coef)
    basis = [F.pow(x, p - 1 - i) if i < p - 1 else F.lit(1.0) for i in range(p)]
    var = F.lit(0.0)
    for i in range(p):
        for j in range(p):
            var = var + float(cov[i][j]) * basis[i] * basis[j]
    rate, half = polynomial(x, coef), z * F.sqrt(var)
    return rate, rate - half, rate + half


def round_half_even(c: Column | str, digits: int = 0) -> Column:
    return F.bround(col(c), digits)


def mapped(c: Column | str, table: dict[str, str]) -> Column:
    """Value of a small fixed dictionary, null where it has none."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[col(c)]
