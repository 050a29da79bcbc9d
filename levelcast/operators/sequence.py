"""Window operators over ordered series: integrals, differences, leads and lags, rates, recurrences."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def ordered(t: str, by: Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(t)


def running(t: str, by: Sequence[str] = ()) -> WindowSpec:
    return ordered(t, by).rowsBetween(Window.unboundedPreceding, 0)


def cumulative_trapezoid(df: DataFrame, x: Column | str, t: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Integral of x over actual time steps, 0 at the first row."""
    x = F.col(x) if isinstance(x, str) else x
    w = ordered(t, by)
    step = 0.5 * (F.col("_x") + F.lag("_x").over(w)) * (F.col(t) - F.lag(t).over(w))
    return df.withColumn("_x", x).withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn(out, F.sum("_s").over(running(t, by))).drop("_x", "_s")


def cumulative_powers(df: DataFrame, x: str, t: str, order: int, by: Sequence[str] = (), prefix: str = "cum_t") -> DataFrame:
    """Integrals of x, x^2, ... x^order, as columns ``cum_t1``..."""
    for k in range(1, order + 1):
        df = cumulative_trapezoid(df, F.pow(F.col(x), k) if k > 1 else F.col(x), t, f"{prefix}{k}", by)
    return df


def cumulative_steps(df: DataFrame, x: str, t: str, out: str, by: Sequence[str] = (), first: float = 1.0) -> DataFrame:
    """Sum of x times its time step, the first step being ``first``."""
    step = F.coalesce(F.col(t) - F.lag(t).over(ordered(t, by)), F.lit(first))
    return df.withColumn("_s", F.col(x) * step).withColumn(out, F.sum("_s").over(running(t, by))).drop("_s")


def value_at(df: DataFrame, value: str, t: str, year: float, by: Sequence[str] = ()) -> Column:
    """Value of the row nearest to ``year`` in each series (the earlier of two), as a window expression."""
    return F.min_by(value, F.struct(F.abs(F.col(t) - year), F.col(t))).over(Window.partitionBy(*by))


def rebased(df: DataFrame, value: str, t: str, year: float, by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Values less that of the row nearest to ``year``."""
    return df.withColumn(out or value, F.col(value) - value_at(df, value, t, year, by))


def integrated_from(df: DataFrame, rate: str, t: str, year: float, out: str, level: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid in both directions from the row nearest to ``year``, where the level is ``level``."""
    df = cumulative_trapezoid(df, rate, t, out, by)
    return rebased(df, out, t, year, by).withColumn(out, F.col(out) + level)


def sigma_from(df: DataFrame, step_sigma: str, t: str, year: float, out: str, by: Sequence[str] = (), floor_at_mean: str | None = None) -> DataFrame:
    """Errors of steps accumulated in quadrature, outward in both directions from the row nearest to ``year``.

    ``floor_at_mean``: a column whose mean is the least error.
    """
    w = Window.partitionBy(*by)
    base = F.min_by(t, F.struct(F.abs(F.col(t) - year), F.col(t))).over(w)
    df = df.withColumn("_b", base)
    later = F.sum(F.when(F.col(t) > F.col("_b"), F.col(step_sigma) ** 2).otherwise(0.0)).over(running(t, by))
    earlier = F.sum(F.when(F.col(t) < F.col("_b"), F.col(step_sigma) ** 2).otherwise(0.0)).over(ordered(t, by).rowsBetween(0, Window.unboundedFollowing))
    sigma = F.sqrt(F.when(F.col(t) >= F.col("_b"), later).otherwise(earlier))
    if floor_at_mean:
        sigma = F.greatest(sigma, F.avg(floor_at_mean).over(w))
    return df.withColumn(out, sigma).drop("_b")


def difference(x: Column | str, w: WindowSpec, first: float | None = None) -> Column:
    """x less its predecessor; the first row null or ``first``."""
    x = F.col(x) if isinstance(x, str) else x
    d = x - F.lag(x).over(w)
    return d if first is None else F.coalesce(d, F.lit(first))


def midpoint_rates(df: DataFrame, x: str, t: str, by: Sequence[str] = (), also: Sequence[str] = ()) -> DataFrame:
    """Rates between neighbours, at the middle of their times; columns ``also`` averaged over the two."""
    w = ordered(t, by)
    rate = difference(x, w) / difference(t, w)
    out = df.withColumn("rate", rate).withColumn("mid_t", (F.col(t) + F.lag(t).over(w)) / 2)
    for c in also:
        out = out.withColumn(f"mid_{c}", (F.col(c) + F.lag(c).over(w)) / 2)
    return out.filter("rate is not null")


def leads_and_lags(df: DataFrame, x: str, t: str, k: int, by: Sequence[str] = (), prefix: str = "d") -> DataFrame:
    """Columns of x shifted by -k..k rows; rows whose window leaves the series are dropped."""
    w = ordered(t, by)
    for n in range(-k, k + 1):
        shifted = F.lag(x, -n).over(w) if n < 0 else F.lead(x, n).over(w)
        df = df.withColumn(f"{prefix}_{'m' if n < 0 else 'p'}{abs(n)}", shifted)
    return df.na.drop(subset=[f"{prefix}_{'m' if n < 0 else 'p'}{abs(n)}" for n in range(-k, k + 1)])


def centred_rate(df: DataFrame, x: str, t: str, half: int, out: str, by: Sequence[str] = ()) -> DataFrame:
    """(x[i+h] - x[i-h]) / (t[i+h] - t[i-h]); null at the ends."""
    w = ordered(t, by)
    return df.withColumn(out, (F.lead(x, half).over(w) - F.lag(x, half).over(w)) / (F.lead(t, half).over(w) - F.lag(t, half).over(w)))


def gradient(df: DataFrame, x: str, t: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the two one-sided rates; at an end the one there is."""
    w = ordered(t, by)
    back = (F.col(x) - F.lag(x).over(w)) / (F.col(t) - F.lag(t).over(w))
    ahead = (F.lead(x).over(w) - F.col(x)) / (F.lead(t).over(w) - F.col(t))
    return df.withColumn(out, (F.coalesce(back, ahead) + F.coalesce(ahead, back)) / 2)


def rolling_mean(x: str, t: str, rows: int, least: int, by: Sequence[str] = ()) -> Column:
    """Centred mean of an even or odd number of rows; null with fewer than ``least`` values."""
    w = ordered(t, by).rowsBetween(-(rows // 2), rows - rows // 2 - 1)
    return F.when(F.count(x).over(w) >= least, F.avg(x).over(w))


def rolling_sigma(s: str, t: str, rows: int, by: Sequence[str] = ()) -> Column:
    """Error of a rolling mean: root of the sum of squares over the count."""
    w = ordered(t, by).rowsBetween(-(rows // 2), rows - rows // 2 - 1)
    return F.sqrt(F.sum(F.col(s) * F.col(s)).over(w)) / F.count(s).over(w)


def rolling_slope(y: str, t: str, half: int, by: Sequence[str] = ()) -> Column:
    """Slope of a straight line through the rows up to ``half`` before and after."""
    w = ordered(t, by).rowsBetween(-half, half)
    n = F.count(y).over(w)
    sx, sy = F.sum(t).over(w), F.sum(y).over(w)
    return (n * F.sum(F.col(t) * F.col(y)).over(w) - sx * sy) / (n * F.sum(F.col(t) * F.col(t)).over(w) - sx * sx)


def running_max(x: Column | str, t: str, by: Sequence[str] = ()) -> Column:
    return F.max(x).over(running(t, by))


def rate_over_window(df: DataFrame, x: str, t: str, years: float, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Change between the rows nearest to half a window before and after each row, over their distance.

    Only rows strictly before, and strictly after, count; null where there are none.
    """
    from .align import nearest

    knots = df.select(*by, t, x)
    back = df.withColumn("_t", F.col(t)).withColumn(t, F.col(t) - years / 2)
    one = nearest(back, knots, t, [x], by, prefix="_a_").withColumn(t, F.col("_t") + years / 2)
    two = nearest(one, knots, t, [x], by, prefix="_b_").withColumn(t, F.col("_t"))
    ok = (F.col(f"_a_{t}") < F.col(t)) & (F.col(f"_b_{t}") > F.col(t))
    rate = F.when(ok, (F.col(f"_b_{x}") - F.col(f"_a_{x}")) / (F.col(f"_b_{t}") - F.col(f"_a_{t}")))
    return two.withColumn(out, rate).select(*df.columns, out)


#: Decay times of a block of a recurrence: what happened two blocks ago is below a double's precision (exp(-50) = 2e-22).
BLOCK_DECAYS = 50.0


def relaxation(df: DataFrame, forcing: str, t: str, tau: str, out: str, by: Sequence[str] = (), start: float | None = None) -> DataFrame:
    """dS/dt = (T - S) / tau, stepped exactly with the mean forcing of each step; S(0) = T(0) or ``start``.

    ``tau`` is a column that is constant in each series; below 0.01 S follows T. A step is the affine map S -> d S + (1 - d) m, and a
    composition of such maps is one too: the state is the sum of all steps' (1 - d) m, each decayed by the time since. Time is cut into blocks of ``BLOCK_DECAYS``
    decay times; a row takes its own block's steps by a running sum and the block before as one total, so that a series' blocks are dealt to
    tasks and its length does not matter. Forcings must not be null.
    """
    w = ordered(t, by)
    rows = df.select(*by, F.col(tau), F.col(t).cast("double").alias(t), F.col(forcing).cast("double").alias(forcing))
    span = F.greatest(F.col(tau), F.lit(0.01))
    age = (F.col(t) - F.first(t).over(running(t, by))) / span
    passed = (F.col(t) - F.lag(t).over(w)) / span
    given = F.col(forcing) if start is None else F.lit(float(start))
    add = F.when(passed.isNull(), given).otherwise(-F.expm1(-passed) * (F.col(forcing) + F.lag(forcing).over(w)) / 2)
    rows = rows.withColumns({"_e": age, "_b": add}).withColumn("_k", F.floor(F.col("_e") / BLOCK_DECAYS))
    rows = rows.withColumn("_b", F.col("_b") * F.exp(F.col("_e") - F.col("_k") * BLOCK_DECAYS))
    totals = rows.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by], (F.col("_k") + 1).alias("_next")).agg((F.sum("_b") * math.exp(-BLOCK_DECAYS)).alias("_total"))
    match = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    both = rows.join(totals, reduce(lambda a, b: a & b, match, F.col("_k") == F.col("_next")), "left")
    inner = F.sum("_b").over(running(t, [*by, "_k"])) + F.coalesce("_total", F.lit(0.0))
    state = F.when(F.col(tau) < 0.01, F.col(forcing)).otherwise(inner * F.exp(F.col("_k") * BLOCK_DECAYS - F.col("_e")))
    return both.withColumn(out, state).select(*by, tau, t, forcing, out)


def two_layers(df: DataFrame, forcing: str, t: str, tau_up: str, tau_deep: str, by: Sequence[str] = ()) -> DataFrame:
    """An upper state relaxing to the forcing and a deep one relaxing to the upper (columns state_u, state_d).

    A deep time of a million years or more holds the deep state.
    """
    up = relaxation(df.select(*by, t, forcing, tau_up), forcing, t, tau_up, "state_u", by)
    deep = df.groupBy(*by).agg(F.first(tau_deep).alias(tau_deep)) if by else df.agg(F.first(tau_deep).alias(tau_deep))
    both = up.join(deep, list(by)) if by else up.crossJoin(F.broadcast(deep))
    low = relaxation(both.select(*by, t, "state_u", tau_deep), "state_u", t, tau_deep, "state_d", by)
    held = F.first("state_u").over(ordered(t, by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    low = low.withColumn("state_d", F.when(F.col(tau_deep) >= 1e6, held).otherwise(F.col("state_d"))).select(*by, t, "state_d")
    return up.join(low, [*by, t])
