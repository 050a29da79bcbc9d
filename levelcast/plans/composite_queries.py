"""Queries of the compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregate, composite, mixture, regress, resample, skill
from ..sources import tables
from . import fixtures as X
from .fixtures import CELLS, ENS, FORCING, LEVEL, r, rounded
from .projection_queries import DRAWS, YEARLY, part_draws, yearly
from .registry import register, table

_MATCHED = f"{LEVEL}, {FORCING}, fit AS (SELECT regr_slope(level, temp) AS slope, regr_intercept(level, temp) AS intercept FROM level JOIN forcing USING (month))"


def _fit(spark, sf):
    pairs = X.level(spark, sf).select("month", "level").join(X.forcing(spark, sf).select("month", "temp"), "month")
    return regress.simple(pairs, "level", "temp")


@register("composite_transfer", f"WITH {_MATCHED}, {YEARLY} SELECT scenario, year, {r('slope * temp + intercept')} AS ocean FROM yearly, fit")
def composite_transfer(spark, sf):
    out = composite.through_transfer(yearly(spark, sf), _fit(spark, sf), "temp", "ocean")
    return out.select("scenario", "year", rounded("ocean").alias("ocean"))


@register("composite_transfer_draws")
def composite_transfer_draws(spark, sf):
    out = composite.through_transfer(yearly(spark, sf), _fit(spark, sf), "temp", "ocean", ids=mixture.sample_ids(spark, 2000))
    q = aggregate.quantile_summary(out, "ocean", ["scenario", "year"], {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return q.select("scenario", "year", *[rounded(c).alias(c) for c in ("p05", "p50", "p95")])


@register("composite_restricted_fit", f"""WITH {LEVEL}, w AS (SELECT * FROM level WHERE t_year BETWEEN 1994 AND 1997), z AS (SELECT *, level - (SELECT level FROM w ORDER BY abs(t_year - 1995), t_year LIMIT 1) AS v FROM w)
 SELECT {r('regr_slope(v, t_year)')} AS slope, {r('regr_intercept(v, t_year)', 4)} AS intercept, count(*) AS n FROM z""")
def composite_restricted_fit(spark, sf):
    out = composite.restricted_fit(X.level(spark, sf).select("t_year", "level").withColumn("x", F.col("t_year")), "level", "x", "t_year", 1994, 1997, 1995)
    return out.select(rounded("slope").alias("slope"), rounded("intercept", 4).alias("intercept"), "n")


@register("composite_headline", f"""WITH {ENS}, t AS (SELECT scenario, sample_id, year, sum(value) AS v FROM ens WHERE year IN (2024, 2026) GROUP BY 1, 2, 3),
 q AS (SELECT scenario, year, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95, count(*) AS n, var_pop(v) AS vv, avg(v) AS m FROM t GROUP BY 1, 2),
 s AS (SELECT year, var_pop(m) / (avg(vv) + var_pop(m)) AS share, avg(p50) AS mm FROM q GROUP BY 1)
 SELECT scenario, year, {r('p05')} AS p05, {r('p50')} AS p50, {r('p95')} AS p95, n, {r('share')} AS scenario_share, {r('mm')} AS mean_median FROM q JOIN s USING (year)""")
def composite_headline(spark, sf):
    out = composite.headline(X.ensemble(spark, sf), [2024, 2026])
    return out.select("scenario", "year", *[rounded(c).alias(c) for c in ("p05", "p50", "p95")], "n", rounded("scenario_share").alias("scenario_share"), rounded("mean_median").alias("mean_median"))


_QUANTILES = f"{ENS}, q AS (SELECT scenario, component, year, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM ens WHERE component <> 'c0' GROUP BY 1, 2, 3)"


def _quantiles(spark, sf):
    return aggregate.quantile_summary(X.ensemble(spark, sf).filter("component <> 'c0'"), "value", ["scenario", "component", "year"], {"p05": 0.05, "p50": 0.5, "p95": 0.95})


@register("composite_gaussian_moments", f"WITH {_QUANTILES} SELECT scenario, year, {r('sum(p50)')} AS mu, {r('sqrt(sum(power((p95 - p05) / (2 * 1.645), 2)))', 5)} AS sigma FROM q GROUP BY 1, 2")
def composite_gaussian_moments(spark, sf):
    return composite.gaussian_moments(_quantiles(spark, sf), ["scenario", "year"]).select("scenario", "year", rounded("mu").alias("mu"), rounded("sigma", 5).alias("sigma"))


@register("composite_gaussian_combination")
def composite_gaussian_combination(spark, sf):
    own = X.ensemble(spark, sf).filter("component = 'c0'").drop("component")
    out = composite.gaussian_combination(_quantiles(spark, sf), own, ["scenario", "year"])
    return out.select("scenario", "year", "sample_id", rounded("value").alias("value"))


@register("composite_rate_envelope", f"""WITH {DRAWS}, g AS (SELECT range * 0.5 AS temp, c0 + c1 * range * 0.5 + c2 * range * range * 0.25 AS rate, c2 FROM draws, range(0, 9))
 SELECT temp::DOUBLE AS temp, {r('quantile_cont(rate, 0.05)')} AS p05, {r('quantile_cont(rate, 0.5)')} AS p50, {r('quantile_cont(rate, 0.95)')} AS p95, {r('avg((c2 > 0)::INT)')} AS p_convex FROM g GROUP BY 1""")
def composite_rate_envelope(spark, sf):
    temps = spark.range(9).select((F.col("id") * 0.5).alias("temp"))
    out = composite.rate_envelope(part_draws(spark, sf), temps)
    return out.select("temp", *[rounded(c).alias(c) for c in ("p05", "p50", "p95", "p_convex")])


@register("composite_median_curve", f"WITH {YEARLY}, {DRAWS}, m AS (SELECT median(c0) AS c0, median(c1) AS c1, median(c2) AS c2 FROM draws) SELECT scenario, year, {r('c0 + c1 * temp + c2 * temp * temp')} AS rate FROM yearly, m")
def composite_median_curve(spark, sf):
    return composite.median_curve(part_draws(spark, sf), yearly(spark, sf)).select("scenario", "year", rounded("rate").alias("rate"))


@register("composite_regions", """WITH a AS (SELECT year(l_shipdate)::INT AS year, l_returnflag AS region, sum(l_quantity) * 1e6 AS area FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2)
 SELECT year, region, 'flags' AS dataset, area / 1e6 AS area FROM a""")
def composite_regions(spark, sf):
    line = table(spark, sf, "lineitem")
    parts = {f: line.filter(F.col("l_returnflag") == f).groupBy(F.year("l_shipdate").alias("year")).agg((F.sum("l_quantity") * 1e6).alias("area")) for f in ("A", "R")}
    out = composite.of_regions(parts, "flags")
    return out.select("year", "region", "dataset", composite.square_kilometres("area").alias("area"))


@register("composite_sliding_bandwidths")
def composite_sliding_bandwidths(spark, sf):
    pairs = X.level(spark, sf).select("month", "level", "t_year").join(X.forcing(spark, sf).select("month", "temp"), "month").withColumn("series", F.lit("a"))
    out = composite.sliding_bandwidths(pairs, "level", "temp", "t_year", ["series"], (1.5, 2.0, 3.0), least=10.0)
    return out.select("bandwidth", rounded("centre").alias("centre"), "term", rounded("coef", 4).alias("coef"))


# operators that no other query goes through


@register("scalar_marks", f"""SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' END AS flag, {r('least(l_extendedprice / 1e5, 0.32)', 8)} AS capped,
 {r('-l_quantity / 362500.0', 9)} AS level, {r('-ln(1 - l_tax)')} AS depth, CASE WHEN l_discount > 0 THEN {r('ln(l_discount)')} END AS logarithm FROM lineitem""")
def scalar_marks(spark, sf):
    line = table(spark, sf, "lineitem")
    log = S.finite(F.when(F.col("l_discount") > 0, F.log("l_discount")).otherwise(F.lit(float("-inf"))))
    return line.select("l_orderkey", "l_linenumber", S.mapped("l_returnflag", {"A": "accepted", "R": "returned"}).alias("flag"), rounded(S.capped(F.col("l_extendedprice") / 1e5), 8).alias("capped"),
                       rounded(S.mass_to_level("l_quantity"), 9).alias("level"), rounded(S.optical_depth(1 - F.col("l_tax"))).alias("depth"), rounded(log).alias("logarithm"))


@register("resample_dedup_last", "SELECT event_type, user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def resample_dedup_last(spark, sf):
    return resample.dedup(table(spark, sf, "events"), ["event_type", "user_id"], [F.desc("ts"), F.desc("event_id")]).select("event_type", "user_id", "event_id")


@register("source_storage_mass", f"""WITH {CELLS}, k AS (SELECT year, lat, lon, value, weight, 6371000.0 ** 2 * radians(0.5) * radians(0.5) * cos(radians(lat)) AS a FROM cells WHERE NOT (lat < -60 OR (lat > 60 AND lon % 360 BETWEEN 295 AND 350)))
 SELECT year AS "time", {r('sum(value * a) * 1e-14', 5)} AS mass, {r('sqrt(sum(power(weight * a, 2))) * 1e-14', 5)} AS mass_sigma FROM k GROUP BY 1""")
def source_storage_mass(spark, sf):
    cells = X.cells(spark, sf).select(F.col("year").alias("time"), "lat", "lon", F.col("value").alias("lwe_thickness"), F.col("weight").cast("double").alias("uncertainty"))
    return tables.storage_mass(cells).select("time", rounded("mass", 5).alias("mass"), rounded("mass_sigma", 5).alias("mass_sigma"))


@register("skill_transition", f"""WITH {YEARLY}, {DRAWS}, g AS (SELECT scenario, sample_id, year, temp, c1 * 100 AS limit_ FROM yearly, draws)
 SELECT scenario, sample_id, min(CASE WHEN temp < 4.9 + limit_ THEN year END) AS crossing FROM g GROUP BY 1, 2""")
def skill_transition(spark, sf):
    grid = part_draws(spark, sf).crossJoin(F.broadcast(yearly(spark, sf)))
    return skill.transition(grid, "temp", 4.9 + F.col("c1") * 100, "year", ["scenario", "sample_id"])
