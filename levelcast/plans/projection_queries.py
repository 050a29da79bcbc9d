"""Queries of projections and mixtures; draws are rows of tables where an oracle is possible, hashes elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import draws
from ..operators import aggregate, mixture, paths, project, regress
from ..sources.scratch import written
from . import fixtures as X
from .fixtures import r, rounded
from .registry import register, table

#: Yearly forcing of each event type: 31 'years' from 2000, one per day.
YEARLY = """yearly AS (SELECT event_type AS scenario, (1999 + day(ts))::DOUBLE AS year, avg(value) / 10 AS temp FROM events GROUP BY 1, 2)"""
DRAWS = """draws AS (SELECT p_partkey AS sample_id, p_size / 1e3 AS c0, p_retailprice / 1e6 AS c1, (p_partkey % 7) / 1e3 AS c2 FROM part)"""


def yearly(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("scenario"), (1999 + F.dayofmonth("ts")).cast("double").alias("year")).agg((F.avg("value") / 10).alias("temp"))


def part_draws(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("sample_id"), (F.col("p_size") / 1e3).alias("c0"), (F.col("p_retailprice") / 1e6).alias("c1"), ((F.col("p_partkey") % 7) / 1e3).alias("c2"))


@register("project_level_ensemble", f"""WITH {YEARLY}, {DRAWS}, g AS (SELECT scenario, sample_id, year, c0 + c1 * temp + c2 * temp * temp AS rate FROM yearly, draws),
 s AS (SELECT *, coalesce(0.5 * (rate + lag(rate) OVER w) * (year - lag(year) OVER w), 0) AS st FROM g WINDOW w AS (PARTITION BY scenario, sample_id ORDER BY year)), i AS (SELECT *, sum(st) OVER (PARTITION BY scenario, sample_id ORDER BY year) AS i FROM s)
 SELECT scenario, sample_id, year, {r('i - max(CASE WHEN year = 2010 THEN i END) OVER (PARTITION BY scenario, sample_id)')} AS value FROM i""")
def project_level_ensemble(spark, sf):
    out = project.level_ensemble(part_draws(spark, sf), yearly(spark, sf), baseline=2010.0)
    return out.select("scenario", "sample_id", "year", rounded("value").alias("value"))


@register("project_component_band", f"""WITH {YEARLY}, {DRAWS}, t AS (SELECT *, lag(temp) OVER w AS p, year - lag(year) OVER w AS dt FROM yearly WINDOW w AS (PARTITION BY scenario ORDER BY year)),
 i AS (SELECT scenario, year, year - min(year) OVER (PARTITION BY scenario) AS i0, sum(coalesce(0.5 * (temp + p) * dt, 0)) OVER (PARTITION BY scenario ORDER BY year) AS i1, sum(coalesce(0.5 * (temp ** 2 + p ** 2) * dt, 0)) OVER (PARTITION BY scenario ORDER BY year) AS i2 FROM t),
 b AS (SELECT *, i0 - max(CASE WHEN year = 2010 THEN i0 END) OVER w AS j0, i1 - max(CASE WHEN year = 2010 THEN i1 END) OVER w AS j1, i2 - max(CASE WHEN year = 2010 THEN i2 END) OVER w AS j2 FROM i WINDOW w AS (PARTITION BY scenario)),
 e AS (SELECT scenario, year, c0 * j0 + c1 * j1 + c2 * j2 AS value FROM b, draws)
 SELECT scenario, year, {r('quantile_cont(value, 0.05)')} AS p05, {r('quantile_cont(value, 0.5)')} AS p50, {r('quantile_cont(value, 0.95)')} AS p95, {r('avg(value)')} AS mean FROM e GROUP BY 1, 2""")
def project_component_band(spark, sf):
    out = project.ensemble_band(project.component_ensemble(part_draws(spark, sf), yearly(spark, sf), baseline=2010.0, order=2), kept=False)
    return out.select("scenario", "year", *[rounded(c).alias(c) for c in ("p05", "p50", "p95", "mean")])


@register("project_path_sigma", f"""WITH {YEARLY}, g AS (SELECT *, 0.001 + 0.002 * temp + 0.001 * temp * temp AS rate, abs(0.002 + 0.002 * temp) * 0.1 AS ds FROM yearly),
 s AS (SELECT *, coalesce(0.5 * (rate + lag(rate) OVER w) * (year - lag(year) OVER w), 0) AS st, coalesce(year - lag(year) OVER w, 0) * ds AS es FROM g WINDOW w AS (PARTITION BY scenario ORDER BY year)), i AS (SELECT *, sum(st) OVER (PARTITION BY scenario ORDER BY year) AS i FROM s)
 SELECT scenario, year, {r('i - max(CASE WHEN year = 2010 THEN i END) OVER (PARTITION BY scenario)')} AS level,
  {r('sqrt(CASE WHEN year >= 2010 THEN sum(CASE WHEN year > 2010 THEN es * es ELSE 0 END) OVER (PARTITION BY scenario ORDER BY year) ELSE sum(CASE WHEN year < 2010 THEN es * es ELSE 0 END) OVER (PARTITION BY scenario ORDER BY year DESC) END)')} AS level_sigma FROM i""")
def project_path_sigma(spark, sf):
    f = yearly(spark, sf).withColumn("temp_sigma", F.lit(0.1))
    out = project.level_from_temperature(f, [0.001, 0.002, 0.001], "temp", "year", ["scenario"], 2010.0, "temp_sigma")
    return out.select("scenario", "year", rounded("level").alias("level"), rounded("level_sigma").alias("level_sigma"))


def _states(spark, sf):
    return part_draws(spark, sf).withColumns({"tau": 2.0 + F.col("sample_id"), "d": F.lit(0.002), "a": F.col("c2"), "b": F.col("c1"), "bd": F.col("c1") / 2, "c": F.col("c0"), "tau_d": F.lit(60.0), "g_atm": F.col("c1"), "g_ocean": F.col("c2"), "d0": F.col("c0")})


_FOLD = """ord AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY year) AS i FROM yearly), smp AS (SELECT *, 2.0 + sample_id AS tau FROM draws),
 f AS (SELECT scenario, sample_id, tau, c0, c1, c2, i, year, temp, temp::DOUBLE AS state FROM ord, smp WHERE i = 1
  UNION ALL SELECT f.scenario, f.sample_id, f.tau, f.c0, f.c1, f.c2, o.i, o.year, o.temp, (o.temp + f.temp) / 2 + (f.state - (o.temp + f.temp) / 2) * exp(-(o.year - f.year) / f.tau) FROM f JOIN ord o ON o.scenario = f.scenario AND o.i = f.i + 1)"""


@register("project_state_ensemble", f"""WITH RECURSIVE {YEARLY}, {DRAWS}, {_FOLD}, g AS (SELECT *, c0 + c1 * temp + c2 * temp * temp + 0.002 * (state - temp) AS rate FROM f),
 s AS (SELECT *, coalesce(0.5 * (rate + lag(rate) OVER w) * (year - lag(year) OVER w), 0) AS st FROM g WINDOW w AS (PARTITION BY scenario, sample_id ORDER BY year)), n AS (SELECT *, sum(st) OVER (PARTITION BY scenario, sample_id ORDER BY year) AS v FROM s)
 SELECT scenario, sample_id, year, {r('v - max(CASE WHEN year = 2010 THEN v END) OVER (PARTITION BY scenario, sample_id)')} AS value FROM n""")
def project_state_ensemble(spark, sf):
    out = project.state_ensemble(_states(spark, sf), yearly(spark, sf), baseline=2010.0)
    return out.select("scenario", "sample_id", "year", rounded("value").alias("value"))


@register("project_thermosteric", f"""WITH RECURSIVE {YEARLY}, {DRAWS}, {_FOLD}, v AS (SELECT *, c2 * state * state + c1 * state + c0 * (year - 2010) AS v FROM f)
 SELECT scenario, sample_id, year, {r('v - max(CASE WHEN year = 2010 THEN v END) OVER (PARTITION BY scenario, sample_id)')} AS value FROM v""")
def project_thermosteric(spark, sf):
    out = project.thermosteric_ensemble(_states(spark, sf), yearly(spark, sf), baseline=2010.0)
    return out.select("scenario", "sample_id", "year", rounded("value").alias("value"))


#: Upper and deep states of each sample; the deep one relaxes to the upper over 60 years.
_LAYERS = _FOLD.replace("state FROM ord", "state, temp::DOUBLE AS deep FROM ord").replace(
    "exp(-(o.year - f.year) / f.tau) FROM", "exp(-(o.year - f.year) / f.tau) AS up, (f.state + up) / 2 + (f.deep - (f.state + up) / 2) * exp(-(o.year - f.year) / 60.0) FROM"
)


@register("project_thermosteric_two_layers", f"""WITH RECURSIVE {YEARLY}, {DRAWS}, {_LAYERS}, v AS (SELECT *, c2 * state * state + c1 * state + c1 / 2 * deep + c0 * (year - 2010) AS v FROM f)
 SELECT scenario, sample_id, year, {r('v - max(CASE WHEN year = 2010 THEN v END) OVER (PARTITION BY scenario, sample_id)')} AS value FROM v""")
def project_thermosteric_two_layers(spark, sf):
    out = project.thermosteric_ensemble(_states(spark, sf), yearly(spark, sf), layers=2, baseline=2010.0)
    return out.select("scenario", "sample_id", "year", rounded("value").alias("value"))


@register("project_discharge", f"""WITH RECURSIVE {YEARLY}, {DRAWS}, {_FOLD.replace('FROM yearly)', 'FROM (SELECT scenario, year, temp * 0.5 + 0.1 AS temp FROM yearly))')},
 g AS (SELECT f.*, y.temp AS air, lag(y.temp) OVER w AS p, lag(state) OVER w AS ps, f.year - lag(f.year) OVER w AS dt FROM f JOIN yearly y ON f.scenario = y.scenario AND f.year = y.year WINDOW w AS (PARTITION BY f.scenario, sample_id ORDER BY f.year)),
 i AS (SELECT *, sum(coalesce(0.5 * (air + p) * dt, 0)) OVER w AS i1, sum(coalesce(0.5 * (air ** 2 + p ** 2) * dt, 0)) OVER w AS i2, sum(coalesce(0.5 * (state + ps) * dt, 0)) OVER w AS d FROM g WINDOW w AS (PARTITION BY scenario, sample_id ORDER BY year)),
 b AS (SELECT *, c2 * i2 + c1 * i1 AS smb, c1 * i1 + c2 * d + c0 * (year - 2010) AS discharge FROM i),
 z AS (SELECT *, smb - max(CASE WHEN year = 2010 THEN smb END) OVER w AS s0, discharge - max(CASE WHEN year = 2010 THEN discharge END) OVER w AS d1 FROM b WINDOW w AS (PARTITION BY scenario, sample_id))
 SELECT scenario, sample_id, year, {r('s0')} AS smb, {r('d1')} AS discharge, {r('s0 + d1')} AS value FROM z""")
def project_discharge(spark, sf):
    f = yearly(spark, sf).withColumn("ocean", F.col("temp") * 0.5 + 0.1)
    out = project.discharge_ensemble(_states(spark, sf), f, baseline=2010.0)
    return out.select("scenario", "sample_id", "year", *[rounded(c).alias(c) for c in ("smb", "discharge", "value")])


@register("project_delayed_discharge", f"""WITH {YEARLY}, {DRAWS}, g AS (SELECT y.scenario, sample_id, y.year, c1 * coalesce(o.temp, 0) + c2 AS rate FROM yearly y JOIN draws ON true LEFT JOIN yearly o ON o.scenario = y.scenario AND o.year = y.year - sample_id % 4),
 s AS (SELECT *, rate * coalesce(year - lag(year) OVER (PARTITION BY scenario, sample_id ORDER BY year), 1) AS st FROM g), i AS (SELECT *, sum(st) OVER (PARTITION BY scenario, sample_id ORDER BY year) AS i FROM s)
 SELECT scenario, sample_id, year, {r('i - max(CASE WHEN year = 2010 THEN i END) OVER (PARTITION BY scenario, sample_id)')} AS value FROM i""")
def project_delayed_discharge(spark, sf):
    f = yearly(spark, sf).withColumnRenamed("temp", "ocean")
    s = part_draws(spark, sf).select("sample_id", F.col("c1").alias("gamma"), F.col("c2").alias("r0"), (F.col("sample_id") % 4).cast("double").alias("delay"))
    out = project.delayed_discharge(s, f, baseline=2010.0)
    return out.select("scenario", "sample_id", "year", rounded("value").alias("value"))


@register("project_tau_sensitivity", f"""WITH RECURSIVE {YEARLY}, {DRAWS}, taus AS (SELECT range * 5.0 AS tau FROM range(1, 4)), ord AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY year) AS i FROM yearly),
 f AS (SELECT scenario, tau, i, year, temp, temp::DOUBLE AS state FROM ord, taus WHERE i = 1
  UNION ALL SELECT f.scenario, f.tau, o.i, o.year, o.temp, (o.temp + f.temp) / 2 + (f.state - (o.temp + f.temp) / 2) * exp(-(o.year - f.year) / f.tau) FROM f JOIN ord o ON o.scenario = f.scenario AND o.i = f.i + 1),
 g AS (SELECT scenario, tau, sample_id, year, c0 + c1 * temp + c2 * temp * temp + 0.002 * (state - temp) AS rate FROM f, draws),
 s AS (SELECT *, coalesce(0.5 * (rate + lag(rate) OVER w) * (year - lag(year) OVER w), 0) AS st FROM g WINDOW w AS (PARTITION BY scenario, tau, sample_id ORDER BY year)), n AS (SELECT *, sum(st) OVER (PARTITION BY scenario, tau, sample_id ORDER BY year) AS v FROM s),
 z AS (SELECT *, v - max(CASE WHEN year = 2010 THEN v END) OVER (PARTITION BY scenario, tau, sample_id) AS value, CASE WHEN abs(year - 2015) <= 1 THEN 2015.0 WHEN abs(year - 2025) <= 1 THEN 2025.0 END::DOUBLE AS "at" FROM n)
 SELECT scenario, tau::DOUBLE AS tau, "at", {r('quantile_cont(value, 0.05)')} AS p05, {r('quantile_cont(value, 0.5)')} AS p50, {r('quantile_cont(value, 0.95)')} AS p95 FROM z WHERE "at" IS NOT NULL GROUP BY 1, 2, 3""")
def project_tau_sensitivity(spark, sf):
    taus = spark.range(1, 4).select((F.col("id") * 5).cast("double").alias("tau"))
    out = project.tau_sensitivity(_states(spark, sf), yearly(spark, sf), taus, [2015.0, 2025.0], 1.0, baseline=2010.0)
    return out.select("scenario", "tau", "at", *[rounded(c).alias(c) for c in ("p05", "p50", "p95")])


SMB = {"c_t": -300.0, "c_t_sigma": 80.0, "c_t2": -50.0, "c_t2_sigma": 30.0, "smb_0": 380.0}


@register("project_surface_balance")
def project_surface_balance(spark, sf):
    out = project.surface_balance(yearly(spark, sf), mixture.sample_ids(spark, 500), SMB, baseline=2010.0, cap=0.3)
    return project.ensemble_band(out).select("scenario", "year", *[rounded(c).alias(c) for c in ("p05", "p50", "p95")])


def samples(spark, sf, name="part", key="p_partkey"):
    """A sample for every row of a table."""
    return table(spark, sf, name).select(F.col(key).alias("sample_id"))


def discounts(spark, sf, factor, name):
    """Levels that the discounts of the line items stand for."""
    return table(spark, sf, "lineitem").select(F.round(F.col("l_discount") * factor, 4).alias(name)).distinct()


def order_years(spark, sf, *shifts):
    """Years of the orders, each moved by some numbers of years."""
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    return years.select(F.explode(F.array(*[(F.col("y") + s).cast("double") for s in shifts])).alias("year")).distinct()


@register("project_surface_balance_rates")
def project_surface_balance_rates(spark, sf):
    out = project.surface_balance_rates(samples(spark, sf), discounts(spark, sf, 50, "warming"), SMB)
    return out.select("warming", *[rounded(c).alias(c) for c in ("p05", "p50", "p95")])


@register("project_quadratic_extrapolation")
def project_quadratic_extrapolation(spark, sf):
    series = X.level(spark, sf).filter("sigma > 0").withColumn("one", F.lit(1))
    fit = regress.quadratic_fit(series, "t_year", "level", ["one"], 1998.0, "budget", "sigma").first()
    spread = series.agg(F.avg("sigma")).first()[0]
    cov = [[spread**2, 0, 0], [0, fit["var_rate"], 0], [0, 0, fit["var_accel"]]]
    out = project.quadratic_extrapolation(samples(spark, sf), order_years(spark, sf, 0, 8, 16), [fit["level"], fit["rate"], fit["accel"]], cov, 1998.0, 1998.0)
    return aggregate.quantile_summary(out, "value", ["year"]).select("year", *[rounded(c).alias(c) for c in ("p05", "p50", "p95")])


@register("project_independent_decades")
def project_independent_decades(spark, sf):
    q = aggregate.quantile_summary(X.ensemble(spark, sf), "value", ["scenario", "year"], {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    out = project.independent_by_year(q, mixture.sample_ids(spark, 500))
    return aggregate.quantile_summary(out, "value", ["scenario", "year"]).select("scenario", "year", *[rounded(c).alias(c) for c in ("p05", "p50", "p95")])


@register("mixture_endpoints")
def mixture_endpoints(spark, sf):
    e = mixture.endpoints(table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sample_id")))
    return aggregate.quantile_summary(e, "end_mm", ["branch"]).select("branch", "n", *[rounded(c, 4).alias(c) for c in ("p05", "p50", "p95")])


@register("mixture_trajectories")
def mixture_trajectories(spark, sf):
    level = X.level(spark, sf).groupBy(F.year("month").alias("y")).agg(F.avg("level").alias("level"), F.avg("sigma").alias("s"))
    # the orders' years stand for twenty years of observations later
    first = level.agg(F.min("y").alias("y0"), F.min_by("level", "y").alias("l0"))
    observed = level.join(F.broadcast(first)).select((F.col("y") + 12).cast("double").alias("year"), ((F.col("level") - F.col("l0")) * 100).alias("mm"), (F.col("s") * 100).alias("sigma"))
    anchor = observed.agg(F.max_by("mm", "year"), F.max_by("sigma", "year")).first()
    t = mixture.trajectories(samples(spark, sf), order_years(spark, sf, 5, 12, 20, 50, 100, 150), anchor[0], anchor[1], observed=observed)
    return aggregate.quantile_summary(t, "value", ["year"]).select("year", "n", *[rounded(c).alias(c) for c in ("p05", "p50", "p95")])


@register("mixture_sensitivity")
def mixture_sensitivity(spark, sf):
    base = dict(C.INSTABILITY)
    variants = {"base": base, "S2 up": mixture.tornado_weight(base, "S2", 0.05), "S2 down": mixture.tornado_weight(base, "S2", -0.05), "S2 wider": mixture.overridden(base, high=("S2", 2, 1200.0)), "S3 symmetric": mixture.overridden(base, alpha=("S3", 3, 0.0))}
    out = mixture.sensitivity(samples(spark, sf, "orders", "o_orderkey"), variants, 2100)
    return out.select("variant", *[rounded(c).alias(c) for c in ("p05", "p50", "p95")])


@register("mixture_one_year")
def mixture_one_year(spark, sf):
    out = mixture.at_year(samples(spark, sf, "orders", "o_orderkey"), 2060, 5.4, 0.4, mode="B")
    return aggregate.quantile_summary(out, "value", ["branch"]).select("branch", "n", *[rounded(c).alias(c) for c in ("p05", "p50", "p95")])


@register("draws_prior_predictive")
def draws_prior_predictive(spark, sf):
    """Rates a T^2 + b T + c under priors a ~ Exp, b ~ half-normal, c ~ normal at five temperatures."""
    ids = samples(spark, sf, "orders", "o_orderkey")
    par = ids.select(draws.exponential("prior/a", "sample_id", scale=0.002171).alias("a"), F.abs(draws.normal("prior/b", "sample_id", sigma=0.005)).alias("b"), draws.normal("prior/c", "sample_id", sigma=0.002).alias("c"))
    temps = discounts(spark, sf, 20, "temp")
    rate = F.col("a") * F.col("temp") ** 2 + F.col("b") * F.col("temp") + F.col("c")
    grid = written(paths.dealt(par), "prior-samples").crossJoin(F.broadcast(written(temps, "prior-temps")))
    out = aggregate.quantile_summary(grid.withColumn("rate", rate), "rate", ["temp"], {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}, kept=False)
    return out.select("temp", *[rounded(c).alias(c) for c in ("p05", "p50", "p95", "p99", "mean")])
