"""Queries of regressions and local rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, composite, kinematics, regress, resample, sliding
from . import fixtures as X
from .fixtures import FORCING, LEVEL, REGIONAL, r, rounded
from .registry import register

JOINED = "j AS (SELECT l.month, l.t_year, level, sigma, temp, saod FROM level l JOIN forcing f USING (month))"


def joined(spark, sf):
    return X.level(spark, sf).select("month", "t_year", "level", "sigma").join(X.forcing(spark, sf).select("month", "temp", "saod"), "month").withColumn("series", F.lit("all"))


def grid(spark, sf):
    """Levels of each priority against two forcings, on common months."""
    f = X.forcing(spark, sf)
    return X.regional(spark, sf), f.select("t_year", F.lit("temp").alias("forcing"), "temp").unionByName(f.select("t_year", F.lit("saod").alias("forcing"), (F.col("saod") * 10).alias("temp")))


@register("regress_line", f"""WITH {REGIONAL}, x AS (SELECT series, level, t_year - 1998 AS x FROM regional), g AS (SELECT series, regr_slope(level, x) AS b, regr_intercept(level, x) AS a, regr_r2(level, x) AS r2, regr_sxx(level, x) AS sxx, regr_syy(level, x) AS syy, regr_avgx(level, x) AS mx, count(*) AS n FROM x GROUP BY 1)
 SELECT series, {r('b')} AS slope, {r('a')} AS intercept, {r('sqrt(syy * (1 - r2) / (n - 2) / sxx)')} AS slope_se, {r('sqrt(syy * (1 - r2) / (n - 2) * (1 / n + mx * mx / sxx))')} AS intercept_se, {r('sqrt(syy * (1 - r2) / n)')} AS resid_std, n FROM g""")
def regress_line(spark, sf):
    out = regress.simple(X.regional(spark, sf).withColumn("x", F.col("t_year") - 1998), "level", "x", ["series"])
    return out.select("series", *[rounded(c).alias(c) for c in ("slope", "intercept", "slope_se", "intercept_se", "resid_std")], "n")


@register("regress_weighted", f"""WITH {REGIONAL}, x AS (SELECT series, level AS y, t_year - 1998 AS x, 1 / (sigma * sigma) AS w FROM regional WHERE sigma > 0), g AS (SELECT series, sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, count(*) AS n FROM x GROUP BY 1)
 SELECT series, term, n, {r("CASE term WHEN 'x' THEN (s * sxy - sx * sy) / (s * sxx - sx * sx) ELSE (sy * sxx - sx * sxy) / (s * sxx - sx * sx) END")} AS coef FROM g, (VALUES ('x'), ('const')) v(term)""")
def regress_weighted(spark, sf):
    s = X.regional(spark, sf).filter("sigma > 0").withColumns({"x": F.col("t_year") - 1998, "w": 1 / (F.col("sigma") * F.col("sigma"))})
    return regress.linear(s, "level", ["x"], ["series"], "w").select("series", "term", "n", rounded("coef").alias("coef"))


@register("regress_transfer", f"""WITH {LEVEL}, {FORCING}, g AS (SELECT regr_slope(level, temp) AS b, regr_intercept(level, temp) AS a, count(*) AS n FROM level JOIN forcing USING (month)) SELECT {r('b')} AS slope, {r('a')} AS intercept, n FROM g""")
def regress_transfer(spark, sf):
    out = regress.transfer(X.level(spark, sf).select("t_year", "level"), X.forcing(spark, sf).select("t_year", "temp"), "temp", "level", "t_year", tolerance=0.04)
    return out.select(rounded("slope").alias("slope"), rounded("intercept").alias("intercept"), "n")


@register("regress_quadratic", f"""WITH {REGIONAL}, x AS (SELECT series, level AS y, t_year - 1998 AS x FROM regional), m AS (SELECT series, count(*)::DOUBLE AS s0, sum(x) AS s1, sum(x ** 2) AS s2, sum(x ** 3) AS s3, sum(x ** 4) AS s4, sum(y) AS y0, sum(x * y) AS y1, sum(x * x * y) AS y2 FROM x GROUP BY 1),
 d AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det FROM m)
 SELECT series, {r('(y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - s3 * y2) + s2 * (y1 * s3 - s2 * y2)) / det', 5)} AS level, {r('(s0 * (y1 * s4 - s3 * y2) - y0 * (s1 * s4 - s3 * s2) + s2 * (s1 * y2 - y1 * s2)) / det', 5)} AS rate, {r('2 * (s0 * (s2 * y2 - y1 * s3) - s1 * (s1 * y2 - y1 * s2) + y0 * (s1 * s3 - s2 * s2)) / det', 5)} AS accel, s0::BIGINT AS n FROM d""")
def regress_quadratic(spark, sf):
    out = regress.quadratic_fit(X.regional(spark, sf), "t_year", "level", ["series"], 1998.0)
    return out.select("series", *[rounded(c, 5).alias(c) for c in ("level", "rate", "accel")], "n")


@register("regress_quadratic_budget")
def regress_quadratic_budget(spark, sf):
    s = X.regional(spark, sf).filter("sigma > 0")
    out = regress.quadratic_fit(s, "t_year", "level", ["series"], 1998.0, "budget", "sigma")
    return out.select("series", *[rounded(c, 5).alias(c) for c in ("level", "rate", "accel", "var_rate", "var_accel")], "n")


@register("regress_dynamic")
def regress_dynamic(spark, sf):
    out = regress.calibrate_dynamic(joined(spark, sf), "level", "temp", "t_year", ["series"], "sigma", "saod")
    return out.select("series", "term", "n", *[rounded(c, 4).alias(c) for c in ("coef", "se", "r2")])


@register("regress_dynamic_design", f"""WITH {LEVEL}, {FORCING}, {JOINED}, s AS (SELECT *, lag(temp) OVER w AS p, t_year - lag(t_year) OVER w AS dt, coalesce(temp - lag(temp) OVER w, 0) AS d FROM j WINDOW w AS (ORDER BY t_year)),
 x AS (SELECT month, sum(coalesce(0.5 * (temp * temp + p * p) * dt, 0)) OVER (ORDER BY t_year) AS cum_t2, sum(coalesce(0.5 * (temp + p) * dt, 0)) OVER (ORDER BY t_year) AS cum_t1, t_year - min(t_year) OVER () AS trend, lag(d) OVER (ORDER BY t_year) AS dt_m1, d AS dt_p0, lead(d) OVER (ORDER BY t_year) AS dt_p1 FROM s)
 SELECT month, {', '.join(f"{r(c)} AS {c}" for c in ('cum_t2', 'cum_t1', 'trend', 'dt_m1', 'dt_p0', 'dt_p1'))} FROM x WHERE dt_m1 IS NOT NULL AND dt_p1 IS NOT NULL""")
def regress_dynamic_design(spark, sf):
    design, names = regress.dynamic_design(joined(spark, sf), "temp", "t_year", 2, 1)
    return design.select("month", *[rounded(c).alias(c) for c in names])


@register("regress_robustness_matrix")
def regress_robustness_matrix(spark, sf):
    levels, forcings = grid(spark, sf)
    out = regress.robustness_matrix(levels, forcings, "t_year", "level", "temp")
    return out.select("series", "forcing", "term", "n", *[rounded(c, 4).alias(c) for c in ("coef", "se", "r2")])


@register("regress_grid_summary", f"""WITH {REGIONAL}, {FORCING}, f AS (SELECT t_year, 'temp' AS forcing, temp FROM forcing UNION ALL SELECT t_year, 'saod', saod * 10 FROM forcing), g AS (SELECT series, forcing, regr_slope(level, temp) AS b, count(*) AS n FROM regional JOIN f USING (t_year) GROUP BY 1, 2)
 SELECT forcing, {r('avg(b)', 5)} AS mean, {r('median(b)', 5)} AS median, {r('stddev_pop(b)', 5)} AS std, {r('min(b)', 5)} AS least, {r('max(b)', 5)} AS most, count(*) AS n_pairs FROM g WHERE n >= 30 GROUP BY 1""")
def regress_grid_summary(spark, sf):
    levels, forcings = grid(spark, sf)
    fits = regress.simple(levels.join(forcings, "t_year"), "level", "temp", ["series", "forcing"]).withColumnRenamed("n", "n_obs")
    out = aggregate.grid_summary(fits, "slope", ["forcing"])
    return out.select("forcing", *[rounded(c, 5).alias(c) for c in ("mean", "median", "std", "least", "most")], "n_pairs")


_SLIDE = {(i, j): f"sum(w * x{i} * x{j})" for i in (1, 2, 3, 4) for j in range(i, 5)}


@register(
    "regress_sliding_sums",
    f"""WITH {REGIONAL}, {FORCING}, j AS (SELECT series, month, regional.t_year AS t, level, sigma, temp * 10 - 5 AS temp, saod * 100 - 4 AS saod FROM regional JOIN forcing USING (month) WHERE sigma > 0),
 d AS (SELECT *, t - min(t) OVER (PARTITION BY series) AS tr, coalesce((temp + lag(temp) OVER o) / 2 * (t - lag(t) OVER o), 0) AS st, coalesce((saod + lag(saod) OVER o) / 2 * (t - lag(t) OVER o), 0) AS ss FROM j WINDOW o AS (PARTITION BY series ORDER BY t)),
 e AS (SELECT *, sum(st) OVER o AS ct, sum(ss) OVER o AS cs FROM d WINDOW o AS (PARTITION BY series ORDER BY t)),
 c AS (SELECT series, t, level - avg(level) OVER s AS y, sigma, ct - avg(ct) OVER s AS x1, tr - avg(tr) OVER s AS x2, cs - avg(cs) OVER s AS x3, 1.0::DOUBLE AS x4 FROM e WINDOW s AS (PARTITION BY series)),
 n AS (SELECT series, q.t AS centre, y, x1, x2, x3, x4, power(1 - power(abs(c.t - q.t) / 2.5, 3), 3) / (sigma * sigma) AS w FROM c JOIN (SELECT DISTINCT series, t FROM c) q USING (series) WHERE abs(c.t - q.t) <= 2.5),
 m AS (SELECT series, centre, count(*) AS n, sum(w) ** 2 / sum(w * w) AS n_eff, {", ".join(f"{e} AS a{i}{j}" for (i, j), e in _SLIDE.items())}, {", ".join(f"sum(w * x{i} * y) AS b{i}" for i in (1, 2, 3, 4))} FROM n WHERE w > 1e-12 GROUP BY 1, 2),
 g1 AS (SELECT *, a24 / a44 AS f2, a14 / a44 AS f1, a34 / a44 AS f3 FROM m WHERE n_eff >= 15 AND n > 4),
 g2 AS (SELECT series, centre, n, n_eff, a11 - a14 * f1 AS c11, a12 - a14 * f2 AS c12, a13 - a14 * f3 AS c13, a22 - a24 * f2 AS c22, a23 - a24 * f3 AS c23, a33 - a34 * f3 AS c33, b1 - b4 * f1 AS d1, b2 - b4 * f2 AS d2, b3 - b4 * f3 AS d3 FROM g1),
 h AS (SELECT *, c11 * (c22 * c33 - c23 * c23) - c12 * (c12 * c33 - c23 * c13) + c13 * (c12 * c23 - c22 * c13) AS det FROM g2),
 k AS (SELECT series, centre, n, n_eff, unnest(['cum_t1', 'trend', 'cum_saod']) AS term, unnest([(d1 * (c22 * c33 - c23 * c23) - c12 * (d2 * c33 - c23 * d3) + c13 * (d2 * c23 - c22 * d3)) / det,
   (c11 * (d2 * c33 - c23 * d3) - d1 * (c12 * c33 - c23 * c13) + c13 * (c12 * d3 - d2 * c13)) / det, (c11 * (c22 * d3 - d2 * c23) - c12 * (c12 * d3 - d2 * c13) + d1 * (c12 * c23 - c22 * c13)) / det]) AS coef FROM h)
 SELECT series, {r("centre")} AS centre, term, n, {r("n_eff", 4)} AS n_eff, {r("coef", 4)} AS coef FROM k""",
)
def regress_sliding_sums(spark, sf):
    """Coefficients of a level on a forcing, the trend and a second forcing about every month of every series."""
    # anomalies of the forcings: an integral of a constant would be the trend
    f = X.forcing(spark, sf).select("month", (F.col("temp") * 10 - 5).alias("temp"), (F.col("saod") * 100 - 4).alias("saod"))
    s = X.regional(spark, sf).filter("sigma > 0").join(f, "month")
    out = sliding.sliding_dynamic(s, "level", "temp", "t_year", ["series"], 2.5, 1, 0, 15.0, sigma="sigma", saod="saod").filter("term <> 'const'")
    return out.select("series", rounded("centre").alias("centre"), "term", "n", rounded("n_eff", 4).alias("n_eff"), rounded("coef", 4).alias("coef"))


@register("regress_sliding_grid")
def regress_sliding_grid(spark, sf):
    """Widths by data sets: every level series against two forcings, each with the other as second forcing."""
    f = X.forcing(spark, sf).withColumn("saod", F.col("saod") * 10)
    pairs = f.select("t_year", F.lit("temp").alias("forcing"), "temp", "saod").unionByName(f.select("t_year", F.lit("saod").alias("forcing"), F.col("saod").alias("temp"), F.col("temp").alias("saod")))
    out = composite.sliding_grid(X.regional(spark, sf).filter("sigma > 0"), pairs, "t_year", "level", "temp", (2.0, 2.5, 3.0), order=1, n_lags=1, least=15.0, sigma="sigma", saod="saod")
    return out.select("series", "forcing", "bandwidth", rounded("centre").alias("centre"), "term", rounded("coef", 4).alias("coef"), rounded("se", 4).alias("se"), rounded("n_eff", 4).alias("n_eff"))


@register("regress_sliding_dynamic")
def regress_sliding_dynamic(spark, sf):
    out = sliding.sliding_dynamic(joined(spark, sf), "level", "temp", "t_year", ["series"], 2.5, 1, 1, 20)
    return out.select("series", rounded("centre").alias("centre"), "term", "n", *[rounded(c, 3).alias(c) for c in ("coef", "se", "n_eff")])


@register("regress_nonlinearity")
def regress_nonlinearity(spark, sf):
    out = regress.nonlinearity(joined(spark, sf), "level", "temp", ["series"], "sigma")
    return out.select("series", "degree", "recommended", *[rounded(c, 4).alias(c) for c in ("r2", "aic", "bic", "f_p")])


@register("regress_second_forcing")
def regress_second_forcing(spark, sf):
    out = regress.second_forcing_test(joined(spark, sf), "level", "temp", "saod", "t_year", ["series"])
    return out.select("series", "by_aic", "by_bic", *[rounded(c, 4).alias(c) for c in ("f", "f_p", "t", "d_aic", "d_bic")])


@register("regress_model_selection")
def regress_model_selection(spark, sf):
    out = regress.model_selection(joined(spark, sf), "t_year", "level", "temp", ["series"])
    return out.select("series", "votes", "recommended", *[rounded(c, 4).alias(c) for c in ("r2_linear", "r2_quadratic", "d_aic", "d_bic", "f", "t")])


@register("regress_power")
def regress_power(spark, sf):
    fits = regress.linear(joined(spark, sf), "level", ["temp"], ["series"]).filter("term = 'temp'")
    out = regress.power_analysis(fits.select("series", "coef", "se", "n"), "coef", "se", "n", 0.0)
    return out.select("series", "differs", *[rounded(c, 4).alias(c) for c in ("mde", "power")])


def _delays(spark, sf):
    j = joined(spark, sf)
    delays = spark.range(0, 6).select((F.col("id") / 12).alias("delay"))
    return regress.delay_model(j, j.select("series", "t_year", "temp"), "t_year", "level", "sigma", "temp", delays, ["series"], 500)


@register("regress_delay_fits")
def regress_delay_fits(spark, sf):
    return _delays(spark, sf)[0].select("series", rounded("delay").alias("delay"), "n", *[rounded(c, 4).alias(c) for c in ("gamma", "r0", "bic", "weight")])


@register("regress_delay_draws")
def regress_delay_draws(spark, sf):
    return _delays(spark, sf)[1].select("series", "sample_id", rounded("delay").alias("delay"), rounded("gamma", 4).alias("gamma"), rounded("r0", 4).alias("r0"))


@register("regress_skew_normal")
def regress_skew_normal(spark, sf):
    q = aggregate.quantile_summary(X.ensemble(spark, sf), "value", ["scenario", "component"])
    out = regress.skew_normal_fit(q, ["scenario", "component"], [(0.05, "p05"), (0.17, "p17"), (0.5, "p50"), (0.83, "p83"), (0.95, "p95")])
    return out.select("scenario", "component", *[rounded(c, 3).alias(c) for c in ("loc", "scale", "alpha", "rmse")])


@register("regress_budget_target", f"""WITH {REGIONAL}, {LEVEL}, p AS (SELECT t_year, series, level, sigma FROM regional WHERE series < '3'), t AS (SELECT t_year, level, sigma FROM level)
 SELECT {r('t.t_year')} AS t_year, {r('t.level - coalesce(sum(p.level), 0)')} AS level, {r('sqrt(t.sigma * t.sigma + coalesce(sum(p.sigma * p.sigma), 0))')} AS sigma FROM t LEFT JOIN p USING (t_year) GROUP BY t.t_year, t.level, t.sigma""")
def regress_budget_target(spark, sf):
    p = X.regional(spark, sf).filter("series < '3'").withColumnRenamed("series", "component")
    out = regress.budget_target(X.level(spark, sf), p, "t_year", "level", "sigma")
    return out.select(rounded("t_year").alias("t_year"), rounded("level").alias("level"), rounded("sigma").alias("sigma"))


_KIN = f"""WITH {REGIONAL}, p AS (SELECT series, t_year AS t, level AS y, 1 / (sigma * sigma) AS w FROM regional WHERE sigma > 0), k AS (SELECT a.series, a.t AS centre, b.t - a.t AS d, b.y, b.w * power(1 - power(abs(b.t - a.t) / 1.5, 3), 3) AS k FROM p a JOIN p b ON a.series = b.series AND abs(a.t - b.t) <= 1.5),
 m AS (SELECT series, centre, sum(k) AS s0, sum(k * d) AS s1, sum(k * d ** 2) AS s2, sum(k * d ** 3) AS s3, sum(k * d ** 4) AS s4, sum(k * y) AS y0, sum(k * y * d) AS y1, sum(k * y * d * d) AS y2, sum(k * y * y) AS yy, count(*) AS n FROM k WHERE k > 1e-12 GROUP BY 1, 2),
 q AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det FROM m),
 b AS (SELECT *, (y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - s3 * y2) + s2 * (y1 * s3 - s2 * y2)) / det AS c0, (s0 * (y1 * s4 - s3 * y2) - y0 * (s1 * s4 - s3 * s2) + s2 * (s1 * y2 - y1 * s2)) / det AS c1, (s0 * (s2 * y2 - y1 * s3) - s1 * (s1 * y2 - y1 * s2) + y0 * (s1 * s3 - s2 * s2)) / det AS c2 FROM q WHERE n >= 12 AND det > 0),
 kin AS (SELECT series, centre, c0 AS level, c1 AS rate, 2 * c2 AS accel, sqrt((s0 * s4 - s2 * s2) / det * greatest(yy - c0 * y0 - c1 * y1 - c2 * y2, 0) / (n - 3)) AS rate_se, sqrt(4 * (s0 * s2 - s1 * s1) / det * greatest(yy - c0 * y0 - c1 * y1 - c2 * y2, 0) / (n - 3)) AS accel_se, n FROM b)"""


def _kin(spark, sf):
    return kinematics.kinematics(X.regional(spark, sf).filter("sigma > 0"), "t_year", "level", "sigma", 1.5, ["series"])


@register("kinematics", f"{_KIN} SELECT series, {r('centre')} AS centre, {r('level', 5)} AS level, {r('rate', 4)} AS rate, {r('accel', 4)} AS accel, {r('rate_se', 4)} AS rate_se, {r('accel_se', 4)} AS accel_se, n FROM kin")
def kinematics_query(spark, sf):
    return _kin(spark, sf).select("series", rounded("centre").alias("centre"), rounded("level", 5).alias("level"), *[rounded(c, 4).alias(c) for c in ("rate", "accel", "rate_se", "accel_se")], "n")


@register("kinematics_one_per_year", f"{_KIN} SELECT series, floor(centre)::INT AS year, {r('min_by(rate, (round(abs(centre - floor(centre) - 0.5), 9), centre))', 4)} AS rate FROM kin GROUP BY 1, 2")
def kinematics_one_per_year(spark, sf):
    k = _kin(spark, sf).withColumn("centre", F.round("centre", 9))
    return kinematics.one_per_year(k, ["series"]).select("series", "year", rounded("rate", 4).alias("rate"))


@register("kinematics_bandwidths")
def kinematics_bandwidths(spark, sf):
    out = kinematics.kinematics_bandwidths(X.regional(spark, sf).filter("sigma > 0"), "t_year", "level", "sigma", [1.0, 1.5, 2.5], ["series"])
    return out.select("series", "half_width", rounded("centre").alias("centre"), rounded("rate", 4).alias("rate"), rounded("rate_se", 4).alias("rate_se"), "n")


@register("kinematics_error_correlation")
def kinematics_error_correlation(spark, sf):
    centres = resample.annual_mean(X.level(spark, sf).drop("n"), "level").select(F.col("t_year").alias("centre"))
    out = kinematics.correlation_of_rates(centres, 2.0)
    return out.select(rounded("a").alias("a"), rounded("b").alias("b"), rounded("rho").alias("rho"))
