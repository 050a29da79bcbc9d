"""Queries of derived series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, blend, derive, regress, skewed, stacking
from ..sources.scratch import written
from . import fixtures as X
from .fixtures import ENS, FORCING, REGIONAL, r, rounded
from .model_queries import joined
from .projection_queries import YEARLY, yearly
from .registry import register, table

#: A budget table of the line items: terms by year.
BUDGET = """b AS (SELECT year(l_shipdate)::INT AS year, avg(l_extendedprice) / 1e4 AS gmsl, avg(l_quantity) / 10 AS sum_contributors, avg(l_discount) AS glaciers, avg(l_tax) AS greenland, avg(l_linenumber) / 10 AS antarctica, avg(l_quantity) / 100 AS tws, avg(l_discount) / 3 AS reservoir, avg(l_tax) / 3 AS groundwater, avg(l_quantity) / 300 AS tws_natural FROM lineitem GROUP BY 1)"""


def _budget(spark, sf):
    a = F.avg
    b = table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(
        (a("l_extendedprice") / 1e4).alias("gmsl"), (a("l_quantity") / 10).alias("sum_contributors"), a("l_discount").alias("glaciers"), a("l_tax").alias("greenland"), (a("l_linenumber") / 10).alias("antarctica"),
        (a("l_quantity") / 100).alias("tws"), (a("l_discount") / 3).alias("reservoir"), (a("l_tax") / 3).alias("groundwater"), (a("l_quantity") / 300).alias("tws_natural"),
    )
    return b.withColumns({f"{c}_sigma": F.col(c) * 0.1 for c in b.columns if c != "year"})


@register("derive_budget_sums", f"""WITH {BUDGET} SELECT year, {r('glaciers + greenland + antarctica + tws')} AS barystatic, {r('0.1 * sqrt(glaciers ** 2 + greenland ** 2 + antarctica ** 2 + tws ** 2)')} AS barystatic_sigma, {r('reservoir + groundwater + tws_natural')} AS sum_tws,
 {r('gmsl - tws')} AS thermodynamic_total, {r('0.1 * sqrt(gmsl ** 2 + tws ** 2)')} AS thermodynamic_total_sigma, {r('sum_contributors - tws')} AS thermodynamic_sum FROM b""")
def derive_budget_sums(spark, sf):
    out = derive.thermodynamic_signal(_budget(spark, sf))
    return out.select("year", *[rounded(c).alias(c) for c in ("barystatic", "barystatic_sigma", "sum_tws", "thermodynamic_total", "thermodynamic_total_sigma", "thermodynamic_sum")])


@register("derive_standardised", f"""WITH {REGIONAL} SELECT series, month, {r('(level - avg(level) OVER w) / stddev_pop(level) OVER w', 5)} AS level, {r('avg(level) OVER w')} AS level_mean FROM regional WINDOW w AS (PARTITION BY series)""")
def derive_standardised(spark, sf):
    out = derive.standardised(X.regional(spark, sf), ["level"], ["series"])
    return out.select("series", "month", rounded("level", 5).alias("level"), rounded("level_mean").alias("level_mean"))


@register("derive_prepared_series", f"""WITH {REGIONAL}, y AS (SELECT series, floor(t_year)::INT AS year, avg(level) AS level FROM regional GROUP BY 1, 2), b AS (SELECT series, year, level - avg(CASE WHEN abs(year + 0.5 - 1998) <= 2 THEN level END) OVER (PARTITION BY series) AS level FROM y), f AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM b WHERE year + 0.5 >= 1996)
 SELECT series, year, {r('level')} AS level FROM f WHERE n >= 5""")
def derive_prepared_series(spark, sf):
    out = derive.prepared_series(X.regional(spark, sf), "level", start=1996.0, baseline=1998.0, window=2.0, least=5)
    return out.select("series", "year", rounded("level").alias("level"))


@register("derive_extended", f"""WITH {REGIONAL}, d AS (SELECT * FROM regional WHERE t_year < 1999), l AS (SELECT series, max(t_year) AS lt, max_by(level, t_year) AS lv, max_by(sigma, t_year) AS ls FROM d GROUP BY 1),
 x AS (SELECT r.*, l.*, coalesce(0.5 * (r.level + lag(r.level) OVER w) * (t_year - lag(t_year) OVER w), 0) AS st, coalesce(t_year - lag(t_year) OVER w, 0) * sigma AS es FROM regional r JOIN l USING (series) WHERE t_year >= lt WINDOW w AS (PARTITION BY series ORDER BY t_year)),
 c AS (SELECT series, t_year, lt, lv + sum(st) OVER (PARTITION BY series ORDER BY t_year) AS level, sqrt(ls * ls + sum(es * es) OVER (PARTITION BY series ORDER BY t_year)) AS sigma FROM x)
 SELECT series, {r('t_year')} AS t_year, {r('level')} AS level, {r('sigma')} AS sigma FROM (SELECT series, t_year, level, sigma FROM d UNION ALL SELECT series, t_year, level, sigma FROM c WHERE t_year > lt)""")
def derive_extended(spark, sf):
    s = X.regional(spark, sf)
    rates = s.select("series", "t_year", F.col("level").alias("rate"), F.col("sigma").alias("rate_sigma"))
    out = derive.extended(s.filter("t_year < 1999"), rates, "level", "sigma", "rate", "rate_sigma", "t_year", ["series"])
    return out.select("series", rounded("t_year").alias("t_year"), rounded("level").alias("level"), rounded("sigma").alias("sigma"))


@register("derive_dual_response", f"""WITH {YEARLY}, g AS (SELECT scenario, year, temp, (coalesce(b, a) + coalesce(a, b)) / 2 AS dt FROM (SELECT *, (temp - lag(temp) OVER w) / (year - lag(year) OVER w) AS b, (lead(temp) OVER w - temp) / (lead(year) OVER w - year) AS a FROM yearly WINDOW w AS (PARTITION BY scenario ORDER BY year))),
 s AS (SELECT scenario, year, 0.0056 * (temp + 0.41) - 0.049 * dt AS rate FROM g), i AS (SELECT scenario, year, sum(st) OVER (PARTITION BY scenario ORDER BY year) AS i FROM (SELECT *, coalesce(0.5 * (rate + lag(rate) OVER w) * (year - lag(year) OVER w), 0) AS st FROM s WINDOW w AS (PARTITION BY scenario ORDER BY year)))
 SELECT scenario, year, {r('i - max(CASE WHEN year = 2010 THEN i END) OVER (PARTITION BY scenario)')} AS level FROM i""")
def derive_dual_response(spark, sf):
    out = derive.dual_response(yearly(spark, sf), "temp", "year", ["scenario"], 0.0056, -0.41, -0.049, 2010.0)
    return out.select("scenario", "year", rounded("level").alias("level"))


@register("derive_crossovers", f"""WITH {YEARLY}, d AS (SELECT scenario, year, temp - 1.05 AS d, lag(temp - 1.05) OVER w AS p, lag(year) OVER w AS py FROM yearly WINDOW w AS (PARTITION BY scenario ORDER BY year))
 SELECT scenario, {r('min(CASE WHEN p IS NOT NULL AND sign(p) <> sign(d) THEN py + (year - py) * p / (p - d) END)', 5)} AS crossing FROM d GROUP BY 1""")
def derive_crossovers(spark, sf):
    out = derive.crossovers(yearly(spark, sf).withColumn("c", F.lit(1.05)), "temp", "c", "year", ["scenario"])
    return out.select("scenario", rounded("crossing", 5).alias("crossing"))


@register("derive_roughness", f"WITH {FORCING}, s AS (SELECT year(month)::INT AS y, abs(temp - lag(temp) OVER (PARTITION BY year(month) ORDER BY t_year)) AS s FROM forcing) SELECT y, {r('max(s)')} AS most, {r('avg(s)')} AS mean FROM s GROUP BY 1")
def derive_roughness(spark, sf):
    out = derive.roughness(X.forcing(spark, sf).withColumn("y", F.year("month")), "temp", "t_year", ["y"])
    return out.select("y", rounded("most").alias("most"), rounded("mean").alias("mean"))


@register("derive_hindcast_blend", f"""WITH {REGIONAL}, e AS (SELECT t_year, avg(level) / 10 AS x FROM regional GROUP BY 1),
 g AS (SELECT series, t_year, (coalesce(b, a) + coalesce(a, b)) / 2 AS own FROM (SELECT series, t_year, (level - lag(level) OVER w) / (t_year - lag(t_year) OVER w) AS b, (lead(level) OVER w - level) / (lead(t_year) OVER w - t_year) AS a FROM regional WINDOW w AS (PARTITION BY series ORDER BY t_year))),
 m AS (SELECT series, t_year, own / (1 + exp((t_year - 1998) / 0.7)) + (1 - 1 / (1 + exp((t_year - 1998) / 0.7))) * x AS rate FROM g JOIN e USING (t_year)),
 c AS (SELECT series, t_year, sum(st) OVER (PARTITION BY series ORDER BY t_year) AS v FROM (SELECT *, coalesce(0.5 * (rate + lag(rate) OVER w) * (t_year - lag(t_year) OVER w), 0) AS st FROM m WINDOW w AS (PARTITION BY series ORDER BY t_year)))
 SELECT series, {r('t_year')} AS t_year, {r('v - max(CASE WHEN t_year = 1999 THEN v END) OVER (PARTITION BY series)', 5)} AS blended FROM c""")
def derive_hindcast_blend(spark, sf):
    s = X.regional(spark, sf)
    e = s.groupBy("t_year").agg((F.avg("level") / 10).alias("rate")).crossJoin(F.broadcast(s.select("series").distinct())).select("series", "t_year", "rate")
    out = blend.blend_hindcast(s, e, "level", "t_year", ["series"], 1998.0, 0.7, 1999.0)
    return out.select("series", rounded("t_year").alias("t_year"), rounded("blended", 5).alias("blended"))


@register("derive_degree_probabilities")
def derive_degree_probabilities(spark, sf):
    out = derive.degree_probabilities(X.regional(spark, sf).filter("sigma > 0"), "level", "t_year", ["series"], sigma="sigma")
    return out.select("series", "degree", rounded("bic", 3).alias("bic"), rounded("probability", 4).alias("probability"))


@register("derive_leave_future_out")
def derive_leave_future_out(spark, sf):
    ends = spark.range(1997, 2001).select(F.col("id").cast("double").alias("end"))
    out = derive.leave_future_out(joined(spark, sf), "level", "t_year", ["series"], ends, 1, 1.0)
    return out.select("series", "end", "n", *[rounded(c, 4).alias(c) for c in ("bias", "rmse", "log_score")])


@register("derive_skew_normal_agreement")
def derive_skew_normal_agreement(spark, sf):
    qs = [(0.05, "p05"), (0.17, "p17"), (0.5, "p50"), (0.83, "p83"), (0.95, "p95")]
    q = aggregate.quantile_summary(X.ensemble(spark, sf), "value", ["scenario", "component"])
    fit = regress.skew_normal_fit(q, ["scenario", "component"], qs).join(q, ["scenario", "component"])
    out = derive.skew_normal_agreement(fit.select("scenario", "component", "loc", "scale", "alpha", *[c for _, c in qs]), "loc", "scale", "alpha", qs)
    return out.select("scenario", "component", rounded("worst", 3).alias("worst"))


@register("derive_stacking")
def derive_stacking(spark, sf):
    """Weights of three trends for every order priority, and the most that leaving one fold out moves them."""
    ends = table(spark, sf, "orders").select(F.year("o_orderdate").cast("double").alias("end")).distinct()
    scores = stacking.fold_scores(X.regional(spark, sf), "level", "t_year", ["series"], ends, {"flat": 0, "line": 1, "curve": 2}, 1.0, 12)
    weights, influence = stacking.stacked(scores, ["series"])
    moved = influence.groupBy("series").agg(F.max("moved").alias("moved"))
    return weights.join(moved, "series").select("series", "model", "n", rounded("weight", 3).alias("weight"), rounded("mean_log_density", 3).alias("mean_log_density"), rounded("moved", 3).alias("moved"))


@register("derive_skewed_draws", f"""WITH {ENS}, k AS (SELECT DISTINCT scenario, component, year FROM ens) SELECT scenario, component, year, (SELECT count(*) FROM supplier) AS n, true AS p05, true AS p50, true AS p95 FROM k""")
def derive_skewed_draws(spark, sf):
    """A draw per supplier of the skew-normal fitted to each cell of the ensemble; whether the shares below the fitted quantiles are as they should be."""
    by = ["scenario", "component", "year"]
    q = aggregate.quantile_summary(X.ensemble(spark, sf), "value", by)
    # a cell's row is one task's work: spread them, and keep what was found
    fits = written(regress.skew_normal_fit(q.repartition(64, *by), by, [(0.05, "p05"), (0.17, "p17"), (0.5, "p50"), (0.83, "p83"), (0.95, "p95")]), "skewed-fits")
    ids = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"))
    d = skewed.sampled(fits, ids, by)
    wanted = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    told = skewed.with_grid(fits)
    for name, p in wanted.items():
        told = skewed.inverse(told.withColumn("_u", F.lit(p)), "_u", name)
    told = told.select(*by, *[(F.col("loc") + F.col("scale") * F.col(c)).alias(f"_{c}") for c in wanted])
    share = d.join(F.broadcast(told), by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg((F.col("value") <= F.col(f"_{c}")).cast("double")).alias(c) for c in wanted])
    within = lambda c, p: (F.abs(F.col(c) - p) <= 5 * F.sqrt(p * (1 - p) / F.col("n"))).alias(c)
    return share.select(*by, "n", *[within(c, p) for c, p in wanted.items()])
