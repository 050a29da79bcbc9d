"""Queries over ensembles: sums, quantiles, variance, decisions, densities, skill, blending."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import units as U
from ..operators import aggregate, blend, decision, density, skill
from . import fixtures as X
from .fixtures import CELLS, ENS, FORCING, LEVEL, REGIONAL, r, rounded
from .registry import register, table

BY = ["scenario", "component", "year"]
QS = {"p05": 0.05, "p17": 0.17, "p50": 0.5, "p83": 0.83, "p95": 0.95}
_QSQL = ", ".join(f"{r(f'quantile_cont(value, {q})')} AS {n}" for n, q in QS.items())
TOTAL = "total AS (SELECT scenario, sample_id, year, sum(value) AS value FROM ens GROUP BY 1, 2, 3)"
#: Damage of a level in metres, as SQL.
DAMAGE = "(CASE WHEN {x} < 0 THEN 0 WHEN {x} <= 0.2 THEN 5000 * {x} WHEN {x} <= 0.52 THEN 1000 + 28750 * ({x} - 0.2) WHEN {x} <= 0.63 THEN 10200 + 1500 / 0.11 * ({x} - 0.52) WHEN {x} <= 0.86 THEN 11700 + 10000 * ({x} - 0.63) ELSE 14000 + 13000 / 0.94 * ({x} - 0.86) END)"


def dmg(x: str) -> str:
    return DAMAGE.replace("{x}", f"({x})")


def _total(spark, sf):
    return aggregate.component_sum(X.ensemble(spark, sf), "value", ["scenario", "sample_id", "year"])


@register("ensemble_quantiles", f"WITH {ENS} SELECT scenario, component, year, {_QSQL}, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std, count(value) AS n FROM ens GROUP BY 1, 2, 3")
def ensemble_quantiles(spark, sf):
    out = aggregate.quantile_summary(X.ensemble(spark, sf), "value", BY)
    return out.select(*BY, *[rounded(c).alias(c) for c in (*QS, "mean", "std")], "n")


@register("embedding_quantiles", """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
 SELECT label, pos, (round(quantile_cont(v, 0.05), 5) + 0e0) AS p05, (round(quantile_cont(v, 0.5), 5) + 0e0) AS p50, (round(quantile_cont(v, 0.95), 5) + 0e0) AS p95 FROM e GROUP BY 1, 2""")
def embedding_quantiles(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v")).select("label", (F.col("pos") + 1).cast("long").alias("pos"), F.col("v").cast("double").alias("v"))
    out = aggregate.quantile_summary(e, "v", ["label", "pos"], {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return out.select("label", "pos", *[rounded(c, 5).alias(c) for c in ("p05", "p50", "p95")])


@register("sample_totals", f"WITH {ENS}, {TOTAL} SELECT scenario, sample_id, year, {r('value')} AS value FROM total")
def sample_totals(spark, sf):
    return _total(spark, sf).select("scenario", "sample_id", "year", rounded("value").alias("value"))


@register("total_alternative_component", f"""WITH {ENS}, {TOTAL}, p AS (SELECT * FROM ens WHERE component = 'c1'), q AS (SELECT * FROM ens WHERE component = 'c2')
 SELECT scenario, sample_id, year, {r('total.value - p.value + q.value')} AS value FROM total JOIN p USING (scenario, sample_id, year) JOIN q USING (scenario, sample_id, year)""")
def total_alternative_component(spark, sf):
    e = X.ensemble(spark, sf)
    on = ["scenario", "sample_id", "year"]
    out = aggregate.without(_total(spark, sf), e.filter("component = 'c1'"), e.filter("component = 'c2'"), on, "value")
    return out.select(*on, rounded("value").alias("value"))


@register("exceedance", f"WITH {ENS}, {TOTAL} SELECT scenario, year, {r('100 * avg(CASE WHEN value > 1.0037 - 0.19 THEN 1e0 ELSE 0 END)')} AS over_1, {r('100 * avg(CASE WHEN value > 2.0037 - 0.19 THEN 1e0 ELSE 0 END)')} AS over_2 FROM total GROUP BY 1, 2")
def exceedance(spark, sf):
    out = aggregate.exceedance(_total(spark, sf), "value", ["scenario", "year"], {"over_1": 1.0037, "over_2": 2.0037}, 0.19)
    return out.select("scenario", "year", rounded("over_1").alias("over_1"), rounded("over_2").alias("over_2"))


@register("variance_fractions", f"""WITH {ENS}, {TOTAL}, c AS (SELECT scenario, year, component, var_pop(value) AS v FROM ens GROUP BY 1, 2, 3), t AS (SELECT scenario, year, greatest(var_pop(value), 1e-30) AS tv FROM total GROUP BY 1, 2),
 f AS (SELECT *, v / tv AS f FROM c JOIN t USING (scenario, year))
 SELECT scenario, year, component, {r('f / sum(f) OVER (PARTITION BY scenario, year)')} AS fraction, {r('sum(f) OVER (PARTITION BY scenario, year)')} AS raw_sum FROM f""")
def variance_fractions(spark, sf):
    out = aggregate.variance_fractions(X.ensemble(spark, sf), "value", "component", "sample_id", ["scenario", "year"])
    return out.select("scenario", "year", "component", rounded("fraction").alias("fraction"), rounded("raw_sum").alias("raw_sum"))


@register("law_of_total_variance", f"""WITH {ENS}, {TOTAL}, g AS (SELECT year, scenario, var_pop(value) AS v, avg(value) AS m FROM total GROUP BY 1, 2)
 SELECT year, {r('avg(v)')} AS within, {r('var_pop(m)')} AS across, {r('avg(v) + var_pop(m)')} AS total FROM g GROUP BY 1""")
def law_of_total_variance(spark, sf):
    out = aggregate.total_variance(_total(spark, sf), "value", "scenario", ["year"])
    return out.select("year", *[rounded(c).alias(c) for c in ("within", "across", "total")])


@register("covariance_pairs", f"""WITH {ENS} SELECT a.scenario, a.year, a.component, b.component AS other, {r('covar_samp(a.value, b.value)')} AS covariance FROM ens a JOIN ens b ON a.scenario = b.scenario AND a.year = b.year AND a.sample_id = b.sample_id AND a.component < b.component GROUP BY 1, 2, 3, 4""")
def covariance_pairs(spark, sf):
    out = aggregate.pair_covariances(X.ensemble(spark, sf), "value", "component", "sample_id", ["scenario", "year"])
    return out.select("scenario", "year", "component", "other", rounded("covariance").alias("covariance"))


@register("covariance_sum", f"""WITH {ENS}, {TOTAL}, t AS (SELECT scenario, year, var_samp(value) AS tv FROM total GROUP BY 1, 2), p AS (SELECT scenario, year, sum(v) AS pv FROM (SELECT scenario, year, component, var_samp(value) AS v FROM ens GROUP BY 1, 2, 3) GROUP BY 1, 2)
 SELECT scenario, year, {r('tv - pv')} AS covariance_sum FROM t JOIN p USING (scenario, year)""")
def covariance_sum(spark, sf):
    out = aggregate.covariance_sum(X.ensemble(spark, sf), "value", "component", "sample_id", ["scenario", "year"])
    return out.select("scenario", "year", rounded("covariance_sum").alias("covariance_sum"))


@register("residual_attribution", f"""WITH {ENS}, g AS (SELECT scenario, year, component, median(value) AS m, var_pop(value) AS v FROM ens GROUP BY 1, 2, 3), t AS (SELECT scenario, year, sum(m) AS tm, sum(v) AS tv FROM g GROUP BY 1, 2), o AS (SELECT scenario, year, 2 * avg(value) AS ov FROM ens GROUP BY 1, 2)
 SELECT scenario, year, component, {r('(ov - tm) * v / tv')} AS shift FROM g JOIN t USING (scenario, year) JOIN o USING (scenario, year)""")
def residual_attribution(spark, sf):
    e = X.ensemble(spark, sf)
    o = e.groupBy("scenario", "year").agg((2 * F.avg("value")).alias("value"))
    out = aggregate.residual_attribution(e, o, "value", "component", ["scenario", "year"])
    return out.select("scenario", "year", "component", rounded("shift").alias("shift"))


@register("risk_shares", f"""WITH {ENS}, {TOTAL}, t AS (SELECT scenario, year, avg(value) AS m, avg({dmg('value')}) AS d, count(*) AS n FROM total GROUP BY 1, 2), c AS (SELECT scenario, year, component, sum(value) AS s FROM ens GROUP BY 1, 2, 3)
 SELECT scenario, year, component, {r('d', 4)} AS expected_damage, {r('s / n / m * d', 4)} AS risk FROM c JOIN t USING (scenario, year)""")
def risk_shares(spark, sf):
    out = aggregate.risk_shares(X.ensemble(spark, sf), "value", "component", "sample_id", ["scenario", "year"])
    return out.select("scenario", "year", "component", rounded("expected_damage", 4).alias("expected_damage"), rounded("risk", 4).alias("risk"))


@register("budget_closure", f"""WITH {REGIONAL}, w AS (SELECT t_year, sum(level) AS total, sum(CASE WHEN series < '4' THEN level END) AS parts FROM regional GROUP BY 1), e AS (SELECT * FROM (VALUES ('early', 1995, 1998), ('late', 1998, 2002)) v(epoch, a, b))
 SELECT epoch, {r('regr_slope(parts, t_year)', 5)} AS parts_slope, {r('regr_slope(total, t_year)', 5)} AS total_slope FROM w JOIN e ON t_year BETWEEN a AND b GROUP BY 1""")
def budget_closure(spark, sf):
    w = X.regional(spark, sf).groupBy("t_year").agg(F.sum("level").alias("total"), F.sum(F.when(F.col("series") < "4", F.col("level"))).alias("parts"))
    out = aggregate.closure(w, "total", "parts", "t_year", {"early": (1995, 1998), "late": (1998, 2002)})
    return out.select("epoch", rounded("parts_slope", 5).alias("parts_slope"), rounded("total_slope", 5).alias("total_slope"))


@register("weighted_area_mean", f"""WITH {CELLS}, c AS (SELECT year, lat, lon, avg(value) AS value FROM cells WHERE lat BETWEEN -60 AND 60 AND (lon >= 300 OR lon <= 60) GROUP BY 1, 2, 3), w AS (SELECT *, cos(radians(lat)) AS w FROM c)
 SELECT year, {r('sum(w * value) / sum(w)')} AS mean, {r('sqrt(greatest(sum(w * value * value) / sum(w) - power(sum(w * value) / sum(w), 2), 0))', 5)} AS std FROM w GROUP BY 1""")
def weighted_area_mean(spark, sf):
    box = X.cells(spark, sf).filter("lat between -60 and 60 and (lon >= 300 or lon <= 60)")
    out = aggregate.two_stage_mean(box, "value", F.cos(F.radians("lat")), ["lat", "lon"], "year")
    return out.select("year", rounded("mean").alias("mean"), rounded("std", 5).alias("std"))


@register("mass_integral", f"""WITH {CELLS} SELECT year, {r('1e-5 * sum(value * weight * cos(radians(lat)))')} AS mass, {r('1e-5 * sqrt(sum(power(depth * weight * cos(radians(lat)), 2)))')} AS mass_sigma FROM cells WHERE NOT (lat < -60 OR (lat > 60 AND lon BETWEEN 295 AND 350)) GROUP BY 1""")
def mass_integral(spark, sf):
    c = X.cells(spark, sf).filter("not (lat < -60 or (lat > 60 and lon between 295 and 350))")
    out = aggregate.mass_integral(c, "value", F.col("weight") * F.cos(F.radians("lat")), ["year"], "depth")
    return out.select("year", rounded("mass").alias("mass"), rounded("mass_sigma").alias("mass_sigma"))


@register("cross_scenario_consistency", f"WITH {ENS}, m AS (SELECT component, scenario, avg(value) AS v FROM ens GROUP BY 1, 2) SELECT component, {r('avg(v)')} AS mean, {r('stddev_pop(v)')} AS std, {r('stddev_pop(v) / abs(avg(v))')} AS cv, stddev_pop(v) / abs(avg(v)) < 0.5 AS consistent FROM m GROUP BY 1")
def cross_scenario_consistency(spark, sf):
    m = X.ensemble(spark, sf).groupBy("component", "scenario").agg(F.avg("value").alias("v"))
    out = aggregate.consistency(m, "v", ["component"])
    return out.select("component", *[rounded(c).alias(c) for c in ("mean", "std", "cv")], "consistent")


@register("misfit", f"WITH {LEVEL}, {FORCING} SELECT year(month)::INT AS year, {r('avg(temp * 5 - level)')} AS bias, {r('sqrt(avg(power(temp * 5 - level, 2)))')} AS rmse, {r('avg(power((temp * 5 - level) / sigma, 2))')} AS chi2, count(*) AS n FROM level JOIN forcing USING (month) GROUP BY 1")
def misfit(spark, sf):
    j = X.level(spark, sf).drop("n", "t_year").join(X.forcing(spark, sf).select("month", (F.col("temp") * 5).alias("m")), "month").withColumn("year", F.year("month"))
    out = aggregate.misfit(j, "level", "m", "sigma", ["year"])
    return out.select("year", *[rounded(c).alias(c) for c in ("bias", "rmse", "chi2")], "n")


# scalar functions


@register("scalar_damage", f"SELECT event_id, {r('17.03 * x * x + 145 * x + 260')} AS displaced, {r(dmg('x'))} AS cost FROM (SELECT event_id, value / 20 - 0.05 AS x FROM events)")
def scalar_damage(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("value") / 20 - 0.05).alias("x"))
    return e.select("event_id", rounded(S.people_displaced("x")).alias("displaced"), rounded(S.damage("x")).alias("cost"))


@register("scalar_finance", """SELECT o_orderkey, (round(CASE WHEN h <= 0 THEN 0 ELSE (1 - power(1.03, -h)) / 0.03 END, 6) + 0e0) AS factor, (round(1 / (1 + exp((year(o_orderdate) - 1998) / 1.5)), 6) + 0e0) AS weight FROM (SELECT *, 1999 - year(o_orderdate) AS h FROM orders)""")
def scalar_finance(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    return o.select("o_orderkey", rounded(S.annuity("y", F.lit(1999))).alias("factor"), rounded(S.fading_weight("y", 1998, 1.5)).alias("weight"))


@register("scalar_sigma", f"""WITH {REGIONAL}, s AS (SELECT *, min(t_year) OVER () AS a FROM regional)
 SELECT series, month, {r('(level + sigma - (level - sigma)) / (2 * 1.645)')} AS from_interval, {r('sqrt(sigma * sigma + 0.01 + 0.04)')} AS quadrature,
 {r('CASE WHEN t_year < 1998 THEN sigma * (1 + (3.0 - 1) * (1998 - t_year) / (1998 - a)) ELSE sigma END')} AS tapered, {r('CASE WHEN t_year BETWEEN 1997 AND 1999 THEN sqrt(sigma * sigma + 0.0025) ELSE sigma END')} AS inflated FROM s""")
def scalar_sigma(spark, sf):
    s = X.regional(spark, sf)
    s = s.crossJoin(F.broadcast(s.agg(F.min("t_year").alias("a"))))
    return s.select(
        "series", "month", rounded(S.sigma_from_interval(F.col("level") - F.col("sigma"), F.col("level") + F.col("sigma"))).alias("from_interval"), rounded(S.quadrature("sigma", F.lit(0.1), F.lit(0.2))).alias("quadrature"),
        rounded(S.sigma_taper("sigma", "t_year", F.col("a"), 1998, 3.0)).alias("tapered"), rounded(S.sigma_inflated("sigma", "t_year", 1997, 1999, 0.05)).alias("inflated"),
    )


@register("scalar_units", """SELECT event_id, (round(value / 362500e0, 9) + 0e0) AS level_m, (round(value * 1000, 6) + 0e0) AS mm, (round((value - 32) * 5 / 9e0, 6) + 0e0) AS celsius, (round(value * 0.3048, 6) + 0e0) AS metres, (round(value * 0.001 * 365.25, 9) + 0e0) AS m_per_year FROM events""")
def scalar_units(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", rounded(U.gt_to_m(v), 9).alias("level_m"), rounded(U.m_to_mm(v)).alias("mm"), rounded(U.convert(v, "degF", "degC")).alias("celsius"), rounded(U.convert(v, "ft", "m")).alias("metres"), rounded(U.convert(v, "mm/day", "m/yr"), 9).alias("m_per_year"))


@register("scalar_sentinels", """SELECT o_orderkey, CASE WHEN a <= -999 THEN NULL ELSE a END AS at_most, CASE WHEN abs(b) > 1e20 THEN NULL ELSE b END AS huge, CASE WHEN abs(a + 999.999) < 1e-6 THEN NULL ELSE a END AS equal FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN -999.999e0 ELSE o_totalprice END AS a, CASE WHEN o_orderkey % 5 = 0 THEN 9e36 ELSE o_totalprice END AS b FROM orders)""")
def scalar_sentinels(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, -999.999).otherwise(F.col("o_totalprice")).alias("a"), F.when(F.col("o_orderkey") % 5 == 0, 9e36).otherwise(F.col("o_totalprice")).alias("b"))
    return o.select("o_orderkey", S.null_if_at_most("a", -999).alias("at_most"), S.null_if_huge("b").alias("huge"), S.null_if_equal("a", -999.999).alias("equal"))


@register("scalar_kernels", """SELECT event_id, (round(CASE WHEN abs(u) <= 1 THEN power(1 - power(abs(u), 3), 3) ELSE 0 END, 9) + 0e0) AS tricube, (round(CASE WHEN abs(u) <= 1 THEN 0.75 * (1 - u * u) ELSE 0 END, 9) + 0e0) AS epanechnikov, (round(exp(-u * u / 2), 9) + 0e0) AS gaussian FROM (SELECT event_id, value / 15 - 0.8 AS u FROM events)""")
def scalar_kernels(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("value") / 15 - 0.8).alias("u"))
    return e.select("event_id", *[rounded(S.kernel("u", k), 9).alias(k) for k in ("tricube", "epanechnikov", "gaussian")])


@register("scalar_rate_band", f"""WITH {FORCING} SELECT month, {r('2 * temp * temp + 3 * temp + 1')} AS rate, {r('2 * temp * temp + 3 * temp + 1 - 1.96 * sqrt(0.04 * temp ** 4 + 2 * 0.01 * temp ** 3 + 0.09 * temp ** 2 + 0.01)')} AS low, {r('2 * temp * temp + 3 * temp + 1 + 1.96 * sqrt(0.04 * temp ** 4 + 2 * 0.01 * temp ** 3 + 0.09 * temp ** 2 + 0.01)')} AS high FROM forcing""")
def scalar_rate_band(spark, sf):
    rate, low, high = S.rate_band("temp", [2, 3, 1], [[0.04, 0.01, 0], [0.01, 0.09, 0], [0, 0, 0.01]])
    return X.forcing(spark, sf).select("month", rounded(rate).alias("rate"), rounded(low).alias("low"), rounded(high).alias("high"))


# decisions

ADAPT = 4000.0 * 0.03 * 1.03**75 / (1.03**75 - 1)
_SAMPLES = "s AS (SELECT scenario, year, sample_id, value / 1.5 AS value FROM total)"


def _samples(spark, sf):
    return _total(spark, sf).withColumn("value", F.col("value") / 1.5)


@register("decision_cost_grid", f"""WITH {ENS}, {TOTAL}, {_SAMPLES}, d AS (SELECT range * 0.1 AS design FROM range(0, 40))
 SELECT scenario, year, {r('design::DOUBLE')} AS design, {r(f"{ADAPT!r} * design::DOUBLE + avg({dmg('greatest(value - design::DOUBLE, 0)')})", 4)} AS cost FROM s, d GROUP BY scenario, year, design""")
def decision_cost_grid(spark, sf):
    out = decision.expected_costs(_samples(spark, sf), "value", decision.design_grid(spark, 0.0, 0.1, 40), ["scenario", "year"])
    return out.select("scenario", "year", rounded("design").alias("design"), rounded("cost", 4).alias("cost"))


@register("decision_optimal_defence", f"""WITH {ENS}, {TOTAL}, {_SAMPLES}, d AS (SELECT (range::DOUBLE * 0.02::DOUBLE) AS design FROM range(0, 200)),
 c AS (SELECT scenario, year, design, {ADAPT!r} * design + avg({dmg('greatest(value - design, 0)')}) AS cost FROM s, d GROUP BY 1, 2, 3)
 SELECT scenario, year, {r('arg_min(design, (round(cost, 7), design))')} AS design, {r('min(cost)', 4)} AS cost FROM c GROUP BY 1, 2""")
def decision_optimal_defence(spark, sf):
    costs = decision.expected_costs(_samples(spark, sf), "value", decision.design_grid(spark, 0.0, 0.02, 200), ["scenario", "year"])
    out = decision.optimal_design(costs.withColumn("cost", F.round("cost", 7)), ["scenario", "year"])
    return out.select("scenario", "year", rounded("design").alias("design"), rounded("cost", 4).alias("cost"))


_INFO = f"""WITH {ENS}, {TOTAL}, {_SAMPLES}, d AS (SELECT (0.3::DOUBLE + range::DOUBLE * 0.05::DOUBLE) AS design FROM range(0, 54)),
 f AS (SELECT * FROM s WHERE scenario <> 'view'), st AS (SELECT scenario, year, sample_id, value * 0.6 AS value FROM f),
 q AS (SELECT scenario, year, quantile_cont(value, 0.9) AS q90, quantile_cont(value, 0.975) AS q975 FROM st GROUP BY 1, 2),
 k AS (SELECT scenario, year, count(*) FILTER (value > q975) >= 20 AS many FROM f JOIN q USING (scenario, year) GROUP BY 1, 2),
 un AS (SELECT f.* FROM f JOIN q USING (scenario, year) JOIN k USING (scenario, year) WHERE value > CASE WHEN many THEN q975 ELSE q90 END),
 cost AS (SELECT scenario, year, w, min(c) AS c FROM (SELECT scenario, year, w, design, {ADAPT!r} * design + avg({dmg('greatest(value - design, 0)')}) AS c FROM
   (SELECT *, 'f' AS w FROM f UNION ALL SELECT *, 's' FROM st UNION ALL SELECT *, 'u' FROM un), d GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
 n AS (SELECT scenario, year, count(*) AS n FROM un GROUP BY 1, 2),
 v AS (SELECT scenario, year, max(c) FILTER (w = 'f') AS cf, max(c) FILTER (w = 's') AS cs, max(c) FILTER (w = 'u') AS cu FROM cost GROUP BY 1, 2),
 evpi AS (SELECT scenario, year, CASE WHEN coalesce(n, 0) >= 10 THEN greatest(cf - (0.1 * cs + 0.9 * cu), 0) ELSE 0 END AS evpi FROM v LEFT JOIN n USING (scenario, year))"""


def _evpi(spark, sf):
    f = _samples(spark, sf).filter("scenario <> 'view'")
    st = f.withColumn("value", F.col("value") * 0.6)
    return decision.perfect_information(f, st, "value", decision.design_grid(spark, 0.3, 0.05, 54), ["scenario", "year"])


@register("decision_perfect_information", f"{_INFO} SELECT scenario, year, {r('evpi', 4)} AS evpi FROM evpi")
def decision_perfect_information(spark, sf):
    return _evpi(spark, sf).select("scenario", "year", rounded("evpi", 4).alias("evpi"))


@register("decision_value_surface", f"""{_INFO}, t AS (SELECT 2040 + 10 * (year - 2024) AS target, avg(evpi) AS evpi FROM evpi GROUP BY year)
 SELECT target, arrival, {r('evpi * (1 - power(1.03, arrival - target)) / 0.03 / 1000', 5)} AS voi FROM t, (SELECT (2026 + 4 * range)::INT AS arrival FROM range(0, 10)) WHERE arrival < target""")
def decision_value_surface(spark, sf):
    t = _evpi(spark, sf).groupBy("year").agg(F.avg("evpi").alias("evpi")).select((2040 + 10 * (F.col("year") - 2024)).alias("target"), "evpi")
    arrivals = spark.range(10).select((2026 + 4 * F.col("id")).cast("int").alias("arrival"))
    return decision.value_surface(t, "evpi", arrivals).select("target", "arrival", rounded("voi", 5).alias("voi"))


@register("decision_stability_surface", f"""WITH {ENS}, {TOTAL}, {_SAMPLES}, d AS (SELECT (0.3::DOUBLE + range::DOUBLE * 0.05::DOUBLE) AS design FROM range(0, 54)),
 a AS (SELECT design, {ADAPT!r} * design + avg({dmg('greatest(value * 0.6 - design, 0)')}) AS a FROM s, d GROUP BY 1), b AS (SELECT design, {ADAPT!r} * design + avg({dmg('greatest(value - design, 0)')}) AS b FROM s, d GROUP BY 1),
 g AS (SELECT p, greatest(min(p * a + (1 - p) * b) - (p * min(a) + (1 - p) * min(b)), 0) AS e FROM a JOIN b USING (design), (SELECT (range::DOUBLE * 0.1::DOUBLE) AS p FROM range(1, 10)) GROUP BY 1)
 SELECT {r('p')} AS p, arrival, {r('e * (1 - power(1.03, arrival - 2100)) / 0.03 / 1000', 5)} AS voi FROM g, (SELECT (2030 + 20 * range)::INT AS arrival FROM range(0, 3))""")
def decision_stability_surface(spark, sf):
    s = _samples(spark, sf)
    weights = spark.range(1, 10).select((F.col("id") * 0.1).alias("p"))
    arrivals = spark.range(3).select((2030 + 20 * F.col("id")).cast("int").alias("arrival"))
    out = decision.stability_surface(s.withColumn("value", F.col("value") * 0.6), s, "value", decision.design_grid(spark, 0.3, 0.05, 54), weights, arrivals)
    return out.select(rounded("p").alias("p"), "arrival", rounded("voi", 5).alias("voi"))


@register("decision_threshold_surface", f"""WITH {ENS}, {TOTAL}, {_SAMPLES}, h AS (SELECT (0.203::DOUBLE + 0.25::DOUBLE * range::DOUBLE) AS threshold FROM range(0, 10)), x AS (SELECT threshold, 100 * (avg((value > threshold)::INT) - avg((value * 0.6 > threshold)::INT)) AS dx FROM s, h GROUP BY 1)
 SELECT {r('threshold')} AS threshold, arrival, {r('dx')} AS delta_exceedance, {r(f"dx / 100 * {dmg('threshold')} * (1 - power(1.03, arrival - 2100)) / 0.03 / 1000", 5)} AS voi FROM x, (SELECT (2030 + 20 * range)::INT AS arrival FROM range(0, 3))""")
def decision_threshold_surface(spark, sf):
    s = _samples(spark, sf)
    thresholds = spark.range(10).select((0.203 + 0.25 * F.col("id")).alias("threshold"))
    arrivals = spark.range(3).select((2030 + 20 * F.col("id")).cast("int").alias("arrival"))
    out = decision.threshold_surface(s, s.withColumn("value", F.col("value") * 0.6), "value", thresholds, arrivals)
    return out.select(rounded("threshold").alias("threshold"), "arrival", rounded("delta_exceedance").alias("delta_exceedance"), rounded("voi", 5).alias("voi"))


@register("gaussian_smoothing", f"""WITH {FORCING}, x AS (SELECT row_number() OVER (ORDER BY t_year) - 1 AS i, temp FROM forcing), n AS (SELECT count(*) AS n FROM x), k AS (SELECT range AS k, exp(-0.5 * power(range / 2e0, 2)) AS w FROM range(-8, 9)),
 j AS (SELECT i, w / (SELECT sum(w) FROM k) AS w, ((i + k) % (2 * n) + 2 * n) % (2 * n) AS j, n FROM x, k, n)
 SELECT j.i AS i, {r('sum(w * y.temp)')} AS smooth FROM j JOIN x y ON y.i = CASE WHEN j.j >= j.n THEN 2 * j.n - 1 - j.j ELSE j.j END GROUP BY 1""")
def gaussian_smoothing(spark, sf):
    from pyspark.sql import Window

    s = X.forcing(spark, sf).select((F.row_number().over(Window.orderBy("t_year")) - 1).cast("long").alias("i"), "temp")
    return decision.gaussian_smoothed(s, "temp", "i", 2.0, "smooth").select("i", rounded("smooth").alias("smooth"))


# densities


@register("density_kernel", f"""WITH {ENS}, h AS (SELECT scenario, stddev_samp(value) * power(count(*), -0.2) AS h FROM ens GROUP BY 1), x AS (SELECT (range::DOUBLE * 0.05::DOUBLE) AS x FROM range(0, 40))
 SELECT scenario, {r('x')} AS x, {r('avg(exp(-0.5 * power((x - value) / h, 2)) / (h * sqrt(2 * pi())))')} AS density FROM ens JOIN h USING (scenario), x GROUP BY scenario, x.x""")
def density_kernel(spark, sf):
    out = density.kernel_density(X.ensemble(spark, sf), "value", decision.design_grid(spark, 0.0, 0.05, 40, "x"), ["scenario"])
    return out.select("scenario", rounded("x").alias("x"), rounded("density").alias("density"))


@register("density_histogram", f"""WITH {ENS}, b AS (SELECT scenario, least(floor(value / 0.05), 19)::INT AS bin FROM ens WHERE value BETWEEN 0 AND 1) SELECT scenario, bin, {r('bin * 0.05')} AS "left", count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY scenario) / 0.05')} AS density FROM b GROUP BY 1, 2""")
def density_histogram(spark, sf):
    out = density.histogram(X.ensemble(spark, sf), "value", 0.0, 1.0, 20, ["scenario"])
    return out.select("scenario", "bin", rounded("left").alias("left"), "n", rounded("density").alias("density"))


@register("density_exceedance", f"WITH {ENS}, x AS (SELECT (0.013::DOUBLE + range::DOUBLE * 0.1::DOUBLE) AS x FROM range(0, 20)) SELECT scenario, {r('x')} AS x, {r('100 * avg((value > x)::INT)')} AS exceed FROM ens, x GROUP BY scenario, x.x")
def density_exceedance(spark, sf):
    out = density.exceedance_curve(X.ensemble(spark, sf), "value", decision.design_grid(spark, 0.013, 0.1, 20, "x"), ["scenario"])
    return out.select("scenario", rounded("x").alias("x"), rounded("exceed").alias("exceed"))


@register("density_compared", f"""WITH {ENS}, a AS (SELECT scenario, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM ens WHERE component = 'c0' GROUP BY 1), b AS (SELECT scenario, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.95) AS q95 FROM ens WHERE component = 'c1' GROUP BY 1)
 SELECT scenario, {r('p50')} AS p50, {r('q50')} AS p50_ref, {r('p50 / q50')} AS p50_ratio, {r('p95 / q95')} AS p95_ratio FROM a JOIN b USING (scenario)""")
def density_compared(spark, sf):
    e, q = X.ensemble(spark, sf), {"p50": 0.5, "p95": 0.95}
    a, b = (aggregate.quantile_summary(e.filter(F.col("component") == c), "value", ["scenario"], q) for c in ("c0", "c1"))
    out = density.compared_quantiles(a, b, ["scenario"], ["p50", "p95"])
    return out.select("scenario", *[rounded(c).alias(c) for c in ("p50", "p50_ref", "p50_ratio", "p95_ratio")])


# skill

_SKILL = f"""WITH {ENS}, {TOTAL}, o AS (SELECT scenario, year, avg(value) * 1.05 AS o FROM total WHERE sample_id % 4 = 0 GROUP BY 1, 2), m AS (SELECT scenario, year, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM total GROUP BY 1, 2)"""


def _skill(spark, sf):
    t = _total(spark, sf)
    o = t.filter("sample_id % 4 = 0").groupBy("scenario", "year").agg((F.avg("value") * 1.05).alias("value"))
    return t, o


@register("skill_metrics", f"{_SKILL} SELECT year, {r('avg(m - o)')} AS bias, {r('sqrt(avg(power(m - o, 2)))')} AS rmse, {r('avg((o BETWEEN lo AND hi)::INT)')} AS coverage, count(*) AS n FROM m JOIN o USING (scenario, year) GROUP BY 1")
def skill_metrics(spark, sf):
    t, o = _skill(spark, sf)
    m = aggregate.quantile_summary(t, "value", ["scenario", "year"], {"lo": 0.05, "m": 0.5, "hi": 0.95}).drop("n")
    out = skill.skill_metrics(m.join(o, ["scenario", "year"]), "value", "m", "lo", "hi", ["year"])
    return out.select("year", *[rounded(c).alias(c) for c in ("bias", "rmse", "coverage")], "n")


@register("skill_pit", f"{_SKILL} SELECT scenario, year, {r('avg((value < o)::INT)')} AS pit FROM total JOIN o USING (scenario, year) GROUP BY 1, 2")
def skill_pit(spark, sf):
    t, o = _skill(spark, sf)
    return skill.probability_integral(t, o, "value", ["scenario", "year"]).select("scenario", "year", rounded("pit").alias("pit"))


@register("skill_coverage_curve", f"{_SKILL}, p AS (SELECT scenario, year, avg((value < o)::INT) AS pit FROM total JOIN o USING (scenario, year) GROUP BY 1, 2) SELECT {r('level')} AS level, {r('avg((pit BETWEEN (1 - level) / 2 AND (1 + level) / 2)::INT)')} AS coverage FROM p, (SELECT (range::DOUBLE * 0.1::DOUBLE) AS level FROM range(1, 10)) l GROUP BY l.level")
def skill_coverage_curve(spark, sf):
    t, o = _skill(spark, sf)
    levels = spark.range(1, 10).select((F.col("id") * 0.1).alias("level"))
    out = skill.coverage_curve(skill.probability_integral(t, o, "value", ["scenario", "year"]), levels)
    return out.select(rounded("level").alias("level"), rounded("coverage").alias("coverage"))


@register("skill_by_lead", f"WITH {REGIONAL}, x AS (SELECT series, t_year - 1995 AS lead, level, avg(level) OVER (PARTITION BY series) AS m FROM regional) SELECT (floor(lead / 2) * 2)::DOUBLE AS lead_from, {r('avg(m - level)')} AS bias, {r('sqrt(avg(power(m - level, 2)))')} AS rmse, count(*) AS n FROM x GROUP BY 1 HAVING count(*) >= 3")
def skill_by_lead(spark, sf):
    from pyspark.sql import Window

    s = X.regional(spark, sf).select((F.col("t_year") - 1995).alias("lead"), "level", F.avg("level").over(Window.partitionBy("series")).alias("m"))
    out = skill.skill_by_lead(s, "lead", "level", "m", 2.0)
    return out.select("lead_from", rounded("bias").alias("bias"), rounded("rmse").alias("rmse"), "n")


@register("skill_mixture_quantiles", f"""WITH {ENS}, w AS (SELECT scenario, value, CASE component WHEN 'c0' THEN 0.5 WHEN 'c1' THEN 0.3 ELSE 0.2 END AS w, row_number() OVER (PARTITION BY scenario ORDER BY value, component, sample_id, year) AS i FROM ens),
 c AS (SELECT *, sum(w) OVER (PARTITION BY scenario ORDER BY i) / sum(w) OVER (PARTITION BY scenario) AS c FROM w), p AS (SELECT *, lag(c) OVER (PARTITION BY scenario ORDER BY i) AS pc, lag(value) OVER (PARTITION BY scenario ORDER BY i) AS pv FROM c)
 SELECT scenario, {', '.join(r(f"coalesce(min_by(CASE WHEN pc IS NULL THEN value ELSE pv + ({q} - pc) / (c - pc) * (value - pv) END, c) FILTER (c >= {q}), max(value))", 4) + f' AS q{round(q * 1000):03d}' for q in (0.05, 0.5, 0.95))} FROM p GROUP BY 1""")
def skill_mixture_quantiles(spark, sf):
    w = F.when(F.col("component") == "c0", 0.5).when(F.col("component") == "c1", 0.3).otherwise(0.2)
    out = skill.mixture_quantiles(X.ensemble(spark, sf).withColumn("w", w), "value", "w", [0.05, 0.5, 0.95], ["scenario"])
    return out.select("scenario", *[rounded(c, 4).alias(c) for c in ("q050", "q500", "q950")])


@register("skill_excess_weight", f"""WITH {FORCING}, m AS (SELECT max(temp) AS t FROM forcing WHERE t_year < 1996), x AS (SELECT month, max(greatest(temp - t, 0)) OVER (ORDER BY t_year) AS e FROM forcing, m)
 SELECT month, {r('e')} AS excess, {r('1 / (1 + exp((e - 0.01) / 0.005))')} AS sigmoid, {r('exp(-greatest(e - 0.01, 0) / 0.005)')} AS exponential FROM x""")
def skill_excess_weight(spark, sf):
    f = X.forcing(spark, sf)
    out = skill.excess_forcing(f, "temp", "t_year", f.filter("t_year < 1996").agg(F.max("temp").alias("t_cal_max")))
    return out.select("month", rounded("excess").alias("excess"), *[rounded(skill.synthesis_weight("excess", 0.01, 0.005, k)).alias(k) for k in ("sigmoid", "exponential")])


# blending


@register("blend_rate_space", f"""WITH {REGIONAL}, e AS (SELECT t_year, avg(level) / 10 AS x FROM regional GROUP BY 1),
 g AS (SELECT series, t_year, (coalesce(b, a) + coalesce(a, b)) / 2 AS own FROM (SELECT series, t_year, (level - lag(level) OVER w) / (t_year - lag(t_year) OVER w) AS b, (lead(level) OVER w - level) / (lead(t_year) OVER w - t_year) AS a FROM regional WINDOW w AS (PARTITION BY series ORDER BY t_year))),
 m AS (SELECT series, t_year, x / (1 + exp((t_year - 1998) / 0.7)) + (1 - 1 / (1 + exp((t_year - 1998) / 0.7))) * own AS rate FROM g JOIN e USING (t_year) WHERE t_year >= 1996),
 s AS (SELECT *, coalesce(0.5 * (rate + lag(rate) OVER w) * (t_year - lag(t_year) OVER w), 0) AS st FROM m WINDOW w AS (PARTITION BY series ORDER BY t_year))
 SELECT series, {r('t_year')} AS t_year, {r('rate', 5)} AS rate, {r('0.1 + sum(st) OVER (PARTITION BY series ORDER BY t_year)', 5)} AS blended FROM s""")
def blend_rate_space(spark, sf):
    s = X.regional(spark, sf)
    e = s.groupBy("t_year").agg((F.avg("level") / 10).alias("rate")).join(s.select("series").distinct().withColumn("k", F.lit(1)), how="cross").select("series", "t_year", "rate")
    out = blend.blend_rates(s, e, "level", "t_year", ["series"], 1996.0, 0.1, 1998.0, 0.7)
    return out.select("series", rounded("t_year").alias("t_year"), rounded("rate", 5).alias("rate"), rounded("blended", 5).alias("blended"))
