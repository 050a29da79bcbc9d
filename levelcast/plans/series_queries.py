"""Queries over series: alignment, integrals, differences, rates, resampling, baselines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import timeaxis as A
from ..operators import aggregate, align, resample, sequence
from . import fixtures as X
from .fixtures import CELLS, FORCING, LEVEL, REGIONAL, r, rounded
from .registry import register, table


@register("flagship_level_quantiles", f"""WITH {LEVEL},
 base AS (SELECT *, level - avg(CASE WHEN t_year >= 1996 AND t_year < 1999 THEN level END) OVER () AS anomaly FROM level),
 cum AS (SELECT *, sum(coalesce(0.5 * (anomaly + lag_a) * (t_year - lag_t), 0)) OVER (ORDER BY t_year) AS integral FROM
   (SELECT *, lag(anomaly) OVER (ORDER BY t_year) AS lag_a, lag(t_year) OVER (ORDER BY t_year) AS lag_t FROM base))
 SELECT year(month)::INT AS year, {r('quantile_cont(anomaly, 0.05)')} AS p05, {r('quantile_cont(anomaly, 0.5)')} AS p50, {r('quantile_cont(anomaly, 0.95)')} AS p95,
   {r('max_by(integral, t_year)')} AS integral, count(*) AS n FROM cum GROUP BY 1""")
def flagship(spark, sf):
    """Monthly level, baseline removed, integrated, and summed up by year."""
    s = resample.align_to_baseline(X.level(spark, sf), "level", "t_year", 1996, 1999).withColumnRenamed("level", "anomaly")
    s = sequence.cumulative_trapezoid(s, "anomaly", "t_year", "integral")
    q = F.percentile("anomaly", [0.05, 0.5, 0.95])
    out = s.groupBy(F.year("month").alias("year")).agg(q.alias("q"), F.max_by("integral", "t_year").alias("integral"), F.count(F.lit(1)).alias("n"))
    return out.select("year", *[rounded(F.col("q")[i]).alias(c) for i, c in enumerate(("p05", "p50", "p95"))], rounded("integral").alias("integral"), "n")


# alignment


@register("join_equi_month", f"WITH {LEVEL}, {FORCING} SELECT l.month, {r('level')} AS level, {r('temp')} AS temp, {r('saod')} AS saod FROM level l JOIN forcing f USING (month)")
def join_equi_month(spark, sf):
    out = align.equi(X.level(spark, sf).select("month", "level"), X.forcing(spark, sf).select("month", "temp"), X.forcing(spark, sf).select("month", "saod"), on=["month"])
    return out.select("month", *[rounded(c).alias(c) for c in ("level", "temp", "saod")])


@register("join_equi_year", f"""WITH {LEVEL}, {FORCING}, a AS (SELECT floor(t_year + 0.01)::INT AS y, min_by(level, t_year) AS level FROM level GROUP BY 1),
 b AS (SELECT floor(t_year + 0.01)::INT AS y, min_by(temp, t_year) AS temp FROM forcing GROUP BY 1)
 SELECT y, {r('level')} AS level, {r('temp')} AS temp FROM a JOIN b USING (y)""")
def join_equi_year(spark, sf):
    a = X.level(spark, sf).groupBy(align.yearly_key(F.col("t_year")).alias("y")).agg(F.min_by("level", "t_year").alias("level"))
    b = X.forcing(spark, sf).groupBy(align.yearly_key(F.col("t_year")).alias("y")).agg(F.min_by("temp", "t_year").alias("temp"))
    return align.equi(a, b, on=["y"]).select("y", rounded("level").alias("level"), rounded("temp").alias("temp"))


@register("join_left_fill", f"""WITH {FORCING}, {LEVEL} SELECT f.month, {r('temp')} AS temp, {r('coalesce(level, 0)')} AS level FROM forcing f LEFT JOIN level l USING (month)""")
def join_left_fill(spark, sf):
    out = align.left_fill(X.forcing(spark, sf).select("month", "temp"), X.level(spark, sf).select("month", "level"), ["month"], {"level": 0.0})
    return out.select("month", rounded("temp").alias("temp"), rounded("level").alias("level"))


@register("join_left_median", f"""WITH {FORCING}, {LEVEL}, j AS (SELECT f.month, sigma FROM forcing f LEFT JOIN level l USING (month))
 SELECT month, {r('coalesce(sigma, (SELECT median(sigma) FROM j))')} AS sigma FROM j""")
def join_left_median(spark, sf):
    out = align.left_fill_median(X.forcing(spark, sf).select("month"), X.level(spark, sf).select("month", "sigma"), ["month"], "sigma")
    return out.select("month", rounded("sigma").alias("sigma"))


_DAYS = "days AS (SELECT range::DOUBLE AS x FROM range(0, 32))"
_OBS = """obs AS (SELECT event_type || '/' || user_id AS series, epoch_us(ts) / 86400e6 - epoch_us(TIMESTAMP '2024-01-01') / 86400e6 AS x, value AS v FROM events)"""


def _days(spark):
    return spark.range(0, 32).select(F.col("id").cast("double").alias("x"))


def _obs(spark, sf):
    """A series of values for each event type and user."""
    start = 1704067200 / 86400
    return table(spark, sf, "events").select(F.concat_ws("/", "event_type", "user_id").alias("series"), (A.micros("ts") / 86400e6 - F.lit(start)).alias("x"), F.col("value").alias("v"))


def _queries_for(spark, sf):
    return _obs(spark, sf).select("series").distinct().crossJoin(F.broadcast(_days(spark)))


@register("join_nearest", f"""WITH {_DAYS}, {_OBS}, q AS (SELECT DISTINCT series, d.x FROM obs, days d)
 SELECT series, x, {r('v')} AS v, {r('ox')} AS near_x FROM (SELECT q.series, q.x, o.v, o.x AS ox, row_number() OVER (PARTITION BY q.series, q.x ORDER BY abs(o.x - q.x), o.x) AS n FROM q JOIN obs o USING (series)) WHERE n = 1""")
def join_nearest(spark, sf):
    out = align.nearest(_queries_for(spark, sf), _obs(spark, sf), "x", ["v"], ["series"])
    return out.select("series", "x", rounded("near_v").alias("v"), rounded("near_x").alias("near_x"))


@register("join_nearest_tolerance", f"""WITH {_DAYS}, {_OBS}, q AS (SELECT DISTINCT series, d.x FROM obs, days d)
 SELECT series, x, {r('v')} AS v FROM (SELECT q.series, q.x, o.v, o.x AS ox, row_number() OVER (PARTITION BY q.series, q.x ORDER BY abs(o.x - q.x), o.x) AS n FROM q JOIN obs o USING (series)) WHERE n = 1 AND abs(ox - x) <= 0.5""")
def join_nearest_tolerance(spark, sf):
    out = align.nearest(_queries_for(spark, sf), _obs(spark, sf), "x", ["v"], ["series"], tolerance=0.5)
    return out.select("series", "x", rounded("near_v").alias("v"))


@register("join_as_of", f"""WITH {_DAYS}, {_OBS}, q AS (SELECT DISTINCT series, d.x FROM obs, days d)
 SELECT q.series, q.x, {r('o.v')} AS v FROM q ASOF LEFT JOIN obs o ON q.series = o.series AND q.x >= o.x""")
def join_as_of(spark, sf):
    return align.as_of(_queries_for(spark, sf), _obs(spark, sf), "x", ["v"], ["series"]).select("series", "x", rounded("v").alias("v"))


def _lerp(outside: str) -> str:
    ends = "coalesce(hv, lv)" if outside == "clamp" else "NULL"
    return f"""WITH {_DAYS}, {_OBS}, q AS (SELECT DISTINCT series, d.x FROM obs, days d),
 lo AS (SELECT q.series, q.x, o.x AS lx, o.v AS lv FROM q ASOF LEFT JOIN obs o ON q.series = o.series AND q.x >= o.x),
 hi AS (SELECT q.series, q.x, o.x AS hx, o.v AS hv FROM q ASOF LEFT JOIN obs o ON q.series = o.series AND q.x <= o.x)
 SELECT series, x, {r(f"CASE WHEN lx IS NULL OR hx IS NULL THEN {ends} WHEN hx = lx THEN lv ELSE lv + (x - lx) / (hx - lx) * (hv - lv) END")} AS v FROM lo JOIN hi USING (series, x)"""


@register("join_interpolate_clamp", _lerp("clamp"))
def join_interpolate_clamp(spark, sf):
    return align.interpolate(_queries_for(spark, sf), _obs(spark, sf), "x", ["v"], ["series"]).select("series", "x", rounded("v").alias("v"))


@register("join_interpolate_null", _lerp("null"))
def join_interpolate_null(spark, sf):
    return align.interpolate(_queries_for(spark, sf), _obs(spark, sf), "x", ["v"], ["series"], "null").select("series", "x", rounded("v").alias("v"))


@register("join_lagged_interpolate", f"""WITH {LEVEL}, {FORCING}, q AS (SELECT t_year, lag.range::DOUBLE / 4 AS lag FROM level, range(0, 4) lag),
 lo AS (SELECT q.t_year, q.lag, o.t_year AS lx, o.temp AS lv FROM q ASOF LEFT JOIN forcing o ON q.t_year - q.lag >= o.t_year),
 hi AS (SELECT q.t_year, q.lag, o.t_year AS hx, o.temp AS hv FROM q ASOF LEFT JOIN forcing o ON q.t_year - q.lag <= o.t_year)
 SELECT {r('t_year')} AS t_year, lag, {r("CASE WHEN lx IS NULL OR hx IS NULL THEN coalesce(hv, lv) WHEN hx = lx THEN lv ELSE lv + (t_year - lag - lx) / (hx - lx) * (hv - lv) END", 5)} AS temp FROM lo JOIN hi USING (t_year, lag)""")
def join_lagged_interpolate(spark, sf):
    lags = spark.range(0, 4).select((F.col("id") / 4).alias("lag"))
    out = align.lagged_interpolate(X.level(spark, sf).select("t_year"), X.forcing(spark, sf).select("t_year", "temp"), lags, "t_year", ["temp"])
    return out.select(rounded("t_year").alias("t_year"), "lag", rounded("temp", 5).alias("temp"))


@register("join_priority_outer", """WITH a AS (SELECT c_nationkey AS k, avg(c_acctbal) AS v FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 3 > 0 GROUP BY 1),
 b AS (SELECT s_nationkey AS k, avg(s_acctbal) AS v FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1)
 SELECT k, (round(coalesce(a.v, b.v), 4) + 0e0) AS v FROM a FULL JOIN b USING (k)""")
def join_priority_outer(spark, sf):
    a = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING' and c_nationkey % 3 > 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("v"))
    b = table(spark, sf, "supplier").filter("s_nationkey % 2 = 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("v"))
    return align.prefer(a, b, ["k"], ["v"]).select("k", rounded("v", 4).alias("v"))


@register("join_scenario_replicate", f"WITH {LEVEL} SELECT DISTINCT event_type AS scenario, month, {r('level')} AS level FROM level, events")
def join_scenario_replicate(spark, sf):
    scenarios = table(spark, sf, "events").select(F.col("event_type").alias("scenario")).distinct()
    return align.replicate(X.level(spark, sf).select("month", rounded("level").alias("level")), scenarios).select("scenario", "month", "level")


@register("join_dataset_grid", f"""WITH {REGIONAL}, f AS (SELECT c_mktsegment AS forcing FROM customer GROUP BY 1) SELECT DISTINCT series, forcing FROM regional, f""")
def join_dataset_grid(spark, sf):
    return align.grid(X.regional(spark, sf).select("series").distinct(), table(spark, sf, "customer").select(F.col("c_mktsegment").alias("forcing")).distinct())


@register("join_kernel_range", f"""WITH {LEVEL} SELECT {r('a.t_year')} AS centre, count(*) AS n, {r("sum(power(1 - power(abs(b.t_year - a.t_year) / 1.3, 3), 3))")} AS weight, {r("sum(b.level * power(1 - power(abs(b.t_year - a.t_year) / 1.3, 3), 3)) / sum(power(1 - power(abs(b.t_year - a.t_year) / 1.3, 3), 3))")} AS mean
 FROM level a JOIN level b ON abs(a.t_year - b.t_year) <= 1.3 GROUP BY a.t_year""")
def join_kernel_range(spark, sf):
    s = X.level(spark, sf)
    near = align.within(s.select(F.col("t_year").alias("centre")), s.select("t_year", "level"), "t_year", 1.3)
    k = S.kernel((F.col("t_year") - F.col("centre")) / 1.3)
    out = near.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("weight"), (F.sum(F.col("level") * k) / F.sum(k)).alias("mean"))
    return out.select(rounded("centre").alias("centre"), "n", rounded("weight").alias("weight"), rounded("mean").alias("mean"))


@register("join_semi_isin", "SELECT p_brand, count(*) AS n FROM part WHERE p_brand IN ('Brand#1', 'Brand#5', 'Brand#9') GROUP BY 1")
def join_semi_isin(spark, sf):
    wanted = spark.createDataFrame([("Brand#1",), ("Brand#5",), ("Brand#9",)], "p_brand string")
    return align.semi(table(spark, sf, "part"), F.broadcast(wanted), ["p_brand"]).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@register("join_anti_missing", "SELECT c_nationkey, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01') GROUP BY 1")
def join_anti_missing(spark, sf):
    orders = table(spark, sf, "orders").filter("o_orderdate >= timestamp'2001-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return align.anti(table(spark, sf, "customer"), orders, ["c_custkey"]).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@register("join_name_inner", "SELECT n_name AS name, r_name AS region, count(*) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def join_name_inner(spark, sf):
    n, g, s = table(spark, sf, "nation"), table(spark, sf, "region"), table(spark, sf, "supplier")
    return n.join(g, n.n_regionkey == g.r_regionkey).join(s, s.s_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("name"), F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("suppliers"))


@register("join_cells", f"""WITH {CELLS}, clim AS (SELECT lat, lon, depth, avg(value) AS clim FROM cells WHERE year < 1998 GROUP BY 1, 2, 3),
 anom AS (SELECT lat, lon, depth, year, avg(value) AS value FROM cells WHERE year >= 1998 GROUP BY 1, 2, 3, 4)
 SELECT year, count(*) AS n, {r('avg(value - clim)')} AS anomaly FROM anom JOIN clim USING (lat, lon, depth) GROUP BY 1""")
def join_cells(spark, sf):
    c = X.cells(spark, sf)
    clim = c.filter("year < 1998").groupBy("lat", "lon", "depth").agg(F.avg("value").alias("clim"))
    anom = c.filter("year >= 1998").groupBy("lat", "lon", "depth", "year").agg(F.avg("value").alias("value"))
    return align.equi(anom, clim, on=["lat", "lon", "depth"]).groupBy("year").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.col("value") - F.col("clim"))).alias("anomaly"))


@register("join_rounded_time", f"""WITH {LEVEL}, {FORCING} SELECT round(round_even(l.t_year, 1), 1) AS t_year, count(*) AS n, {r('avg(level)')} AS level, {r('avg(temp)')} AS temp
 FROM level l JOIN forcing f ON round_even(l.t_year, 1) = round_even(f.t_year, 1) GROUP BY 1""")
def join_rounded_time(spark, sf):
    out = align.equi_rounded(X.level(spark, sf).select("t_year", "level"), X.forcing(spark, sf).select("t_year", "temp"), "t_year")
    return out.groupBy(F.round("t_year", 1).alias("t_year")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("level")).alias("level"), rounded(F.avg("temp")).alias("temp"))


# the time axis


@register("decimal_years", """SELECT DISTINCT o_orderdate, round(year(o_orderdate) + (epoch_us(o_orderdate) - epoch_us(date_trunc('year', o_orderdate)::TIMESTAMP)) / (epoch_us(date_trunc('year', o_orderdate + INTERVAL 1 YEAR)::TIMESTAMP) - epoch_us(date_trunc('year', o_orderdate)::TIMESTAMP))::DOUBLE, 9) AS exact,
 round(year(o_orderdate) + (dayofyear(o_orderdate) - 1) / CASE WHEN year(o_orderdate) % 4 = 0 THEN 366e0 ELSE 365e0 END, 9) AS by_day, round(year(o_orderdate) + (month(o_orderdate) - 1) / 12e0 + (day(o_orderdate) - 1) / 365.25e0, 9) AS by_month,
 round(year(o_orderdate) + (month(o_orderdate) - 0.5e0) / 12e0, 9) AS mid_month FROM orders""")
def decimal_years(spark, sf):
    d = table(spark, sf, "orders").select("o_orderdate").distinct()
    forms = {"exact": A.decimal_year, "by_day": A.decimal_year_by_day, "by_month": A.decimal_year_by_month, "mid_month": A.decimal_year_mid_month}
    return d.select("o_orderdate", *[F.round(f("o_orderdate"), 9).alias(n) for n, f in forms.items()])


@register("decimal_year_round_trip", "SELECT o_orderdate AS ts, o_orderdate AS back FROM (SELECT DISTINCT o_orderdate FROM orders)")
def decimal_year_round_trip(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderdate").alias("ts")).distinct()
    return d.select("ts", F.date_trunc("minute", A.from_decimal_year(A.decimal_year("ts")) + F.expr("interval 30 seconds")).alias("back"))


@register("month_dedup_first", "SELECT event_type AS series, date_trunc('month', ts)::TIMESTAMP AS month, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def month_dedup_first(spark, sf):
    out = A.to_month_start(table(spark, sf, "events"), "ts", ["event_type"])
    return out.select(F.col("event_type").alias("series"), "month", "event_id")


@register("series_resolution", """WITH g AS (SELECT o_orderpriority AS series, date_diff('day', lag(d) OVER (PARTITION BY o_orderpriority ORDER BY d), d) AS gap FROM (SELECT DISTINCT o_orderpriority, date_trunc('quarter', o_orderdate)::DATE AS d FROM orders))
 SELECT series, CASE WHEN median(gap) / 30.44 < 1.5 THEN 1 WHEN median(gap) / 30.44 < 4.5 THEN 3 WHEN median(gap) / 30.44 < 9 THEN 6 ELSE 12 END AS resolution_months FROM g GROUP BY 1""")
def series_resolution(spark, sf):
    q = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series"), F.date_trunc("quarter", "o_orderdate").alias("ts")).distinct()
    return A.resolution_months(q, "ts", ["series"])


# integrals, differences, rates


@register("integral_powers", f"""WITH {FORCING}, s AS (SELECT *, lag(temp) OVER w AS p, t_year - lag(t_year) OVER w AS dt FROM forcing WINDOW w AS (ORDER BY t_year))
 SELECT month, {r('sum(coalesce(0.5 * (temp + p) * dt, 0)) OVER (ORDER BY t_year)')} AS cum_t1, {r('sum(coalesce(0.5 * (temp * temp + p * p) * dt, 0)) OVER (ORDER BY t_year)')} AS cum_t2, {r('sum(coalesce(0.5 * (temp ** 3 + p ** 3) * dt, 0)) OVER (ORDER BY t_year)')} AS cum_t3 FROM s""")
def integral_powers(spark, sf):
    out = sequence.cumulative_powers(X.forcing(spark, sf), "temp", "t_year", 3)
    return out.select("month", *[rounded(f"cum_t{k}").alias(f"cum_t{k}") for k in (1, 2, 3)])


@register("integral_left_steps", f"""WITH {REGIONAL} SELECT series, month, {r('sum(level * dt) OVER (PARTITION BY series ORDER BY t_year)')} AS total FROM (SELECT *, coalesce(t_year - lag(t_year) OVER (PARTITION BY series ORDER BY t_year), 1.0) AS dt FROM regional)""")
def integral_left_steps(spark, sf):
    return sequence.cumulative_steps(X.regional(spark, sf), "level", "t_year", "total", ["series"]).select("series", "month", rounded("total").alias("total"))


@register("integral_from_baseline", f"""WITH {REGIONAL}, s AS (SELECT *, lag(level) OVER w AS p, t_year - lag(t_year) OVER w AS dt FROM regional WINDOW w AS (PARTITION BY series ORDER BY t_year)),
 c AS (SELECT *, sum(coalesce(0.5 * (level + p) * dt, 0)) OVER (PARTITION BY series ORDER BY t_year) AS i FROM s),
 b AS (SELECT series, i AS bi FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY abs(t_year - 1998.3), t_year) AS n FROM c) WHERE n = 1)
 SELECT series, month, {r('i - bi + 0.19')} AS total FROM c JOIN b USING (series)""")
def integral_from_baseline(spark, sf):
    return sequence.integrated_from(X.regional(spark, sf), "level", "t_year", 1998.3, "total", 0.19, ["series"]).select("series", "month", rounded("total").alias("total"))


@register("sigma_from_baseline", f"""WITH {REGIONAL}, b AS (SELECT series, t_year AS tb FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY abs(t_year - 1998.3), t_year) AS n FROM regional) WHERE n = 1),
 s AS (SELECT * FROM regional JOIN b USING (series))
 SELECT series, month, {r('''sqrt(CASE WHEN t_year >= tb THEN sum(CASE WHEN t_year > tb THEN sigma * sigma ELSE 0 END) OVER (PARTITION BY series ORDER BY t_year)
   ELSE sum(CASE WHEN t_year < tb THEN sigma * sigma ELSE 0 END) OVER (PARTITION BY series ORDER BY t_year DESC) END)''')} AS sigma FROM s""")
def sigma_from_baseline(spark, sf):
    return sequence.sigma_from(X.regional(spark, sf), "sigma", "t_year", 1998.3, "out", ["series"]).select("series", "month", rounded("out").alias("sigma"))


@register("rates_midpoint", f"""WITH {LEVEL}, {FORCING}, j AS (SELECT l.t_year, level, temp FROM level l JOIN forcing f USING (month))
 SELECT {r('(t_year + pt) / 2')} AS mid_t, {r('(level - pl) / (t_year - pt)', 5)} AS rate, {r('(temp + pp) / 2')} AS mid_temp FROM (SELECT *, lag(t_year) OVER w AS pt, lag(level) OVER w AS pl, lag(temp) OVER w AS pp FROM j WINDOW w AS (ORDER BY t_year)) WHERE pt IS NOT NULL""")
def rates_midpoint(spark, sf):
    j = align.equi(X.level(spark, sf).select("month", "t_year", "level"), X.forcing(spark, sf).select("month", "temp"), on=["month"])
    out = sequence.midpoint_rates(j, "level", "t_year", also=["temp"])
    return out.select(rounded("mid_t").alias("mid_t"), rounded("rate", 5).alias("rate"), rounded("mid_temp").alias("mid_temp"))


@register("difference_prepend_zero", f"WITH {FORCING} SELECT month, {r('coalesce(temp - lag(temp) OVER (ORDER BY t_year), 0)')} AS d_temp FROM forcing")
def difference_prepend_zero(spark, sf):
    return X.forcing(spark, sf).select("month", rounded(sequence.difference("temp", sequence.ordered("t_year"), 0.0)).alias("d_temp"))


@register("leads_and_lags", f"""WITH {FORCING}, s AS (SELECT month, lag(temp, 2) OVER w AS d_m2, lag(temp, 1) OVER w AS d_m1, temp AS d_p0, lead(temp, 1) OVER w AS d_p1, lead(temp, 2) OVER w AS d_p2 FROM forcing WINDOW w AS (ORDER BY t_year))
 SELECT month, {', '.join(r(c) + ' AS ' + c for c in ('d_m2', 'd_m1', 'd_p0', 'd_p1', 'd_p2'))} FROM s WHERE d_m2 IS NOT NULL AND d_p2 IS NOT NULL""")
def leads_and_lags(spark, sf):
    out = sequence.leads_and_lags(X.forcing(spark, sf), "temp", "t_year", 2)
    return out.select("month", *[rounded(c).alias(c) for c in ("d_m2", "d_m1", "d_p0", "d_p1", "d_p2")])


@register("rate_centred", f"""WITH {REGIONAL} SELECT series, month, {r('(lead(level, 3) OVER w - lag(level, 3) OVER w) / (lead(t_year, 3) OVER w - lag(t_year, 3) OVER w)', 5)} AS rate FROM regional WINDOW w AS (PARTITION BY series ORDER BY t_year)""")
def rate_centred(spark, sf):
    return sequence.centred_rate(X.regional(spark, sf), "level", "t_year", 3, "rate", ["series"]).select("series", "month", rounded("rate", 5).alias("rate"))


@register("rate_gradient", f"""WITH {REGIONAL}, s AS (SELECT series, month, (level - lag(level) OVER w) / (t_year - lag(t_year) OVER w) AS b, (lead(level) OVER w - level) / (lead(t_year) OVER w - t_year) AS a FROM regional WINDOW w AS (PARTITION BY series ORDER BY t_year))
 SELECT series, month, {r('(coalesce(b, a) + coalesce(a, b)) / 2', 5)} AS rate FROM s""")
def rate_gradient(spark, sf):
    return sequence.gradient(X.regional(spark, sf), "level", "t_year", "rate", ["series"]).select("series", "month", rounded("rate", 5).alias("rate"))


@register("rate_nearest_window", f"""WITH {LEVEL}, q AS (SELECT t_year FROM level),
 a AS (SELECT q.t_year, l.t_year AS ta, l.level AS la, row_number() OVER (PARTITION BY q.t_year ORDER BY round(abs(l.t_year - (q.t_year - 0.45)), 9), l.t_year) AS n FROM q, level l),
 b AS (SELECT q.t_year, l.t_year AS tb, l.level AS lb, row_number() OVER (PARTITION BY q.t_year ORDER BY round(abs(l.t_year - (q.t_year + 0.45)), 9), l.t_year) AS n FROM q, level l)
 SELECT {r('t_year')} AS t_year, {r('CASE WHEN ta < t_year AND tb > t_year THEN (lb - la) / (tb - ta) END', 5)} AS rate FROM (SELECT * FROM a WHERE n = 1) JOIN (SELECT * FROM b WHERE n = 1) USING (t_year)""")
def rate_nearest_window(spark, sf):
    out = sequence.rate_over_window(X.level(spark, sf).select("t_year", "level"), "level", "t_year", 0.9, "rate")
    return out.select(rounded("t_year").alias("t_year"), rounded("rate", 5).alias("rate"))


@register("rolling_mean", f"""WITH {REGIONAL} SELECT series, month, {r('CASE WHEN count(level) OVER w >= 10 THEN avg(level) OVER w END')} AS mean, {r('sqrt(sum(sigma * sigma) OVER w) / count(sigma) OVER w')} AS sigma
 FROM regional WINDOW w AS (PARTITION BY series ORDER BY t_year ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)""")
def rolling_mean(spark, sf):
    s = X.regional(spark, sf)
    return s.select("series", "month", rounded(sequence.rolling_mean("level", "t_year", 20, 10, ["series"])).alias("mean"), rounded(sequence.rolling_sigma("sigma", "t_year", 20, ["series"])).alias("sigma"))


@register("rolling_slope", f"""WITH {REGIONAL} SELECT series, month, {r('regr_slope(level, t_year) OVER (PARTITION BY series ORDER BY t_year ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)', 4)} AS slope FROM regional""")
def rolling_slope(spark, sf):
    s = X.regional(spark, sf).withColumn("x", F.col("t_year") - 1998)
    return s.select("series", "month", rounded(sequence.rolling_slope("level", "x", 6, ["series"]), 4).alias("slope"))


@register("running_maximum", f"WITH {REGIONAL} SELECT series, month, {r('max(greatest(level - 2.5, 0)) OVER (PARTITION BY series ORDER BY t_year)')} AS overshoot FROM regional")
def running_maximum(spark, sf):
    over = F.greatest(F.col("level") - 2.5, F.lit(0.0))
    return X.regional(spark, sf).select("series", "month", rounded(sequence.running_max(over, "t_year", ["series"])).alias("overshoot"))


@register("relaxation_state", f"""WITH RECURSIVE {FORCING}, s AS (SELECT row_number() OVER (ORDER BY t_year) AS i, month, t_year, temp FROM forcing),
 f AS (SELECT i, month, t_year, temp, temp AS state FROM s WHERE i = 1
   UNION ALL SELECT s.i, s.month, s.t_year, s.temp, (s.temp + f.temp) / 2 + (f.state - (s.temp + f.temp) / 2) * exp(-(s.t_year - f.t_year) / 5.0) FROM f JOIN s ON s.i = f.i + 1)
 SELECT month, {r('state')} AS state FROM f""")
def relaxation_state(spark, sf):
    s = X.forcing(spark, sf).withColumn("tau", F.lit(5.0)).withColumn("one", F.lit(1))
    out = sequence.relaxation(s, "temp", "t_year", "tau", "state", ["one"])
    return s.join(out.select(F.col("t_year"), "state"), "t_year").select("month", rounded("state").alias("state"))


@register("two_layer_state", f"""WITH RECURSIVE {FORCING}, s AS (SELECT row_number() OVER (ORDER BY t_year) AS i, month, t_year, temp FROM forcing),
 f AS (SELECT i, month, t_year, temp, temp AS u, temp AS d FROM s WHERE i = 1
   UNION ALL SELECT i, month, t_year, temp, nu AS u, (nu + u) / 2 + (d - (nu + u) / 2) * exp(-dt / 40.0) AS d FROM
     (SELECT s.i, s.month, s.t_year, s.temp, f.u, f.d, s.t_year - f.t_year AS dt, (s.temp + f.temp) / 2 + (f.u - (s.temp + f.temp) / 2) * exp(-(s.t_year - f.t_year) / 3.0) AS nu FROM f JOIN s ON s.i = f.i + 1))
 SELECT month, {r('u')} AS upper, {r('d')} AS deep FROM f""")
def two_layer_state(spark, sf):
    s = X.forcing(spark, sf).withColumns({"tau_u": F.lit(3.0), "tau_d": F.lit(40.0), "one": F.lit(1)})
    out = sequence.two_layers(s, "temp", "t_year", "tau_u", "tau_d", ["one"])
    return s.join(out.select("t_year", "state_u", "state_d"), "t_year").select("month", rounded("state_u").alias("upper"), rounded("state_d").alias("deep"))


# resampling and baselines


@register("baseline_window", f"WITH {REGIONAL} SELECT series, month, {r('level - avg(CASE WHEN t_year >= 1996 AND t_year < 1999 THEN level END) OVER (PARTITION BY series)')} AS level FROM regional")
def baseline_window(spark, sf):
    return resample.align_to_baseline(X.regional(spark, sf), "level", "t_year", 1996, 1999, ["series"]).select("series", "month", rounded("level").alias("level"))


@register("baseline_harmonised", f"""WITH {REGIONAL} SELECT series, month, {r('level - b')} AS level, {r('level - sigma - b')} AS level_lower, {r('level + sigma - b')} AS level_upper, {r('sigma')} AS sigma FROM (SELECT *, avg(CASE WHEN year(month) BETWEEN 1996 AND 1998 THEN level END) OVER (PARTITION BY series) AS b FROM regional)""")
def baseline_harmonised(spark, sf):
    s = X.regional(spark, sf).withColumns({"level_lower": F.col("level") - F.col("sigma"), "level_upper": F.col("level") + F.col("sigma")})
    out = resample.harmonize_baseline(s, "level", "t_year", (1996, 1998), ["series"])
    return out.select("series", "month", *[rounded(c).alias(c) for c in ("level", "level_lower", "level_upper", "sigma")])


@register("baseline_rebase_around", f"WITH {REGIONAL} SELECT series, month, {r('level - coalesce(avg(CASE WHEN abs(t_year - 1990) <= 5 THEN level END) OVER w, avg(CASE WHEN abs(t_year - 1990) <= 10 THEN level END) OVER w)')} AS level FROM regional WINDOW w AS (PARTITION BY series)")
def baseline_rebase_around(spark, sf):
    return resample.rebase_around(X.regional(spark, sf), "level", "t_year", 1990, 5, ["series"]).select("series", "month", rounded("level").alias("level"))


@register("baseline_nearest_year", f"""WITH {REGIONAL}, b AS (SELECT series, level AS lb FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY abs(t_year - 1997.26), t_year) AS n FROM regional) WHERE n = 1)
 SELECT series, month, {r('level - lb')} AS level FROM regional JOIN b USING (series)""")
def baseline_nearest_year(spark, sf):
    return sequence.rebased(X.regional(spark, sf), "level", "t_year", 1997.26, ["series"]).select("series", "month", rounded("level").alias("level"))


@register("annual_mean", f"""WITH {LEVEL} SELECT floor(t_year)::INT AS year, {r('avg(level)')} AS level, {r('sqrt(avg(sigma * sigma))')} AS sigma, count(level) AS n FROM level GROUP BY 1 HAVING count(level) >= 10""")
def annual_mean(spark, sf):
    out = resample.annual_mean(X.level(spark, sf).drop("n"), "level", least=10, sigma="sigma")
    return out.select("year", rounded("level").alias("level"), rounded("sigma").alias("sigma"), "n")


@register("annual_last", f"WITH {REGIONAL} SELECT series, floor(t_year)::INT AS year, {r('max_by(level, t_year)')} AS level, {r('max_by(sigma, t_year)')} AS sigma FROM regional GROUP BY 1, 2")
def annual_last(spark, sf):
    out = resample.annual_last(X.regional(spark, sf), ["level", "sigma"], by=["series"])
    return out.select("series", "year", rounded("level").alias("level"), rounded("sigma").alias("sigma"))


@register("round_year_mean", f"WITH {LEVEL} SELECT round_even(t_year, 0)::INT AS year, {r('avg(level)')} AS level, count(*) AS n FROM level GROUP BY 1")
def round_year_mean(spark, sf):
    return X.level(spark, sf).groupBy(align.yearly_key(F.col("t_year"), "half_even").alias("year")).agg(rounded(F.avg("level")).alias("level"), F.count(F.lit(1)).alias("n"))


@register("resample_monthly", f"""WITH q AS (SELECT month, level, sigma FROM (WITH {LEVEL} SELECT * FROM level) WHERE month(month) IN (1, 4, 7, 10)),
 g AS (SELECT unnest(generate_series((SELECT min(month) FROM q), (SELECT max(month) FROM q), INTERVAL 1 MONTH)) AS month),
 lo AS (SELECT g.month, q.month AS m0, q.level AS l0, q.sigma AS s0 FROM g ASOF LEFT JOIN q ON g.month >= q.month), hi AS (SELECT g.month, q.month AS m1, q.level AS l1, q.sigma AS s1 FROM g ASOF LEFT JOIN q ON g.month <= q.month),
 x AS (SELECT *, date_diff('day', m0, month)::DOUBLE AS d0, date_diff('day', month, m1)::DOUBLE AS d1 FROM lo JOIN hi USING (month))
 SELECT month, {r('CASE WHEN m0 = m1 THEN l0 ELSE l0 + d0 / (d0 + d1) * (l1 - l0) END')} AS level, {r('CASE WHEN d0 <= d1 THEN s0 ELSE s1 END * sqrt(3)')} AS sigma, least(d0, d1) <= 15 AS is_original, {r('1 / 3e0')} AS weight FROM x""")
def resample_monthly(spark, sf):
    q = X.level(spark, sf).filter("month(month) in (1, 4, 7, 10)").select(F.lit("s").alias("series"), F.col("month").alias("ts"), "level", "sigma")
    out = resample.resample_monthly(q, "ts", "level", "sigma", 3, ["series"])
    return out.select("month", rounded("level").alias("level"), rounded("sigma").alias("sigma"), "is_original", rounded("weight").alias("weight"))


@register("merge_resolutions", f"""WITH {LEVEL}, q AS (SELECT date_trunc('quarter', month)::TIMESTAMP AS month, avg(level) AS level FROM level GROUP BY 1)
 SELECT month, {r('level')} AS level, 1 AS resolution, 1e0 AS weight, 0 AS source FROM level UNION ALL SELECT month, {r('level')}, 3, 3e0, 1 FROM q""")
def merge_resolutions(spark, sf):
    s = X.level(spark, sf).select("month", "level")
    q = s.groupBy(F.date_trunc("quarter", "month").alias("month")).agg(F.avg("level").alias("level"))
    out = resample.merged_resolutions([(s, 1), (q, 3)], ["month", "level"])
    return out.select("month", rounded("level").alias("level"), "resolution", "weight", "source")


@register("history_scenario_union", f"""WITH {REGIONAL}, h AS (SELECT t_year, avg(level) AS level FROM regional GROUP BY 1), s AS (SELECT t_year, level FROM regional WHERE series = '2-HIGH' AND t_year >= 1998)
 SELECT {r('t_year')} AS t_year, {r('coalesce(s.level, h.level) - 0.1')} AS level FROM (SELECT * FROM h WHERE t_year < 1999) h FULL JOIN s USING (t_year)""")
def history_scenario_union(spark, sf):
    s = X.regional(spark, sf)
    h = s.groupBy("t_year").agg(F.avg("level").alias("level"))
    out = resample.history_and_scenario(h, s.filter("series = '2-HIGH' and t_year >= 1998"), "t_year", 1999.0, [], ["level"], 0.1)
    return out.select(rounded("t_year").alias("t_year"), rounded("level").alias("level"))


@register("splice_observed", f"""WITH {REGIONAL}, o AS (SELECT t_year, avg(level) AS v FROM regional GROUP BY 1), last AS (SELECT max_by(v, t_year) AS lo FROM o WHERE t_year <= 1998),
 m AS (SELECT *, first_value(level) OVER (PARTITION BY series ORDER BY abs(t_year - 1998), t_year) AS lm FROM regional)
 SELECT series, month, {r('CASE WHEN t_year <= 1998 AND v IS NOT NULL THEN v ELSE level - lm + lo END')} AS value FROM m LEFT JOIN o USING (t_year), last""")
def splice_observed(spark, sf):
    s = X.regional(spark, sf).withColumnRenamed("level", "value")
    o = s.groupBy("t_year").agg(F.avg("value").alias("value"))
    return resample.spliced(s, o, "t_year", 1998.0, ["series"]).select("series", "month", rounded("value").alias("value"))


@register("densify_linear", f"""WITH {LEVEL}, a AS (SELECT floor(t_year) AS t, avg(level) AS v FROM level GROUP BY 1), g AS (SELECT min(t) + i.range * 0.25 AS t FROM a, range(0, 40) i GROUP BY i.range HAVING min(t) + i.range * 0.25 <= max(t)),
 lo AS (SELECT g.t, a.t AS t0, a.v AS v0 FROM g ASOF LEFT JOIN a ON g.t >= a.t), hi AS (SELECT g.t, a.t AS t1, a.v AS v1 FROM g ASOF LEFT JOIN a ON g.t <= a.t)
 SELECT t::DOUBLE AS t, {r('CASE WHEN t0 = t1 THEN v0 ELSE v0 + (t - t0) / (t1 - t0) * (v1 - v0) END')} AS v FROM lo JOIN hi USING (t)""")
def densify_linear(spark, sf):
    a = X.level(spark, sf).groupBy(F.floor("t_year").cast("double").alias("t")).agg(F.avg("level").alias("v"))
    return resample.densified(a, "t", ["v"], 0.25).select("t", rounded("v").alias("v"))


@register("set_union_distinct", f"WITH {LEVEL}, {FORCING} SELECT month FROM level UNION SELECT month FROM forcing")
def set_union_distinct(spark, sf):
    return X.level(spark, sf).select("month").union(X.forcing(spark, sf).select("month")).distinct()


@register("set_intersection", f"WITH {LEVEL}, {FORCING} SELECT month FROM level INTERSECT SELECT month FROM forcing")
def set_intersection(spark, sf):
    return X.level(spark, sf).select("month").intersect(X.forcing(spark, sf).select("month"))


@register("set_difference", f"WITH {LEVEL}, {FORCING} SELECT month FROM forcing EXCEPT SELECT month FROM level")
def set_difference(spark, sf):
    return X.forcing(spark, sf).select("month").exceptAll(X.level(spark, sf).select("month"))


@register("lag_correlation_scan", f"""WITH {LEVEL}, {FORCING}, q AS (SELECT t_year, level, lag.range::DOUBLE / 12 AS lag FROM level, range(0, 6) lag),
 lo AS (SELECT q.*, o.t_year AS lx, o.temp AS lv FROM q ASOF LEFT JOIN forcing o ON q.t_year - q.lag >= o.t_year), hi AS (SELECT q.*, o.t_year AS hx, o.temp AS hv FROM q ASOF LEFT JOIN forcing o ON q.t_year - q.lag <= o.t_year),
 p AS (SELECT lo.lag, lo.level, CASE WHEN hx = lx THEN lv ELSE lv + (t_year - lag - lx) / (hx - lx) * (hv - lv) END AS temp FROM lo JOIN hi USING (t_year, lag) WHERE lx IS NOT NULL AND hx IS NOT NULL)
 SELECT {r('lag')} AS lag, {r('corr(level, temp)', 4)} AS r FROM p GROUP BY p.lag HAVING count(*) > 3""")
def lag_correlation_scan(spark, sf):
    lags = spark.range(0, 6).select((F.col("id") / 12).alias("lag"))
    out = aggregate.lag_scan(X.level(spark, sf).select("t_year", "level"), X.forcing(spark, sf).select("t_year", "temp"), lags, "level", "temp", "t_year")
    return out.select(rounded("lag").alias("lag"), rounded("r", 4).alias("r"))


@register("entity_trends", """WITH s AS (SELECT n_name AS name, year(o_orderdate) AS y, sum(o_totalprice) / 1e6 AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
 SELECT name, (round(avg(v) FILTER (y < 1998), 6) + 0e0) AS early, (round(avg(v) FILTER (y >= 1998), 6) + 0e0) AS late, (round(regr_slope(v, y), 5) + 0e0) AS slope, count(*) AS n FROM s GROUP BY 1""")
def entity_trends(spark, sf):
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    s = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), n.n_nationkey == c.c_nationkey).groupBy(F.col("n_name").alias("name"), F.year("o_orderdate").alias("y")).agg((F.sum("o_totalprice") / 1e6).alias("v"))
    out = aggregate.entity_trends(s, "v", "y", "name", 1998)
    return out.select("name", rounded("early").alias("early"), rounded("late").alias("late"), rounded("slope", 5).alias("slope"), "n")


@register("top_share_sorted", """SELECT n_name AS name, (round(100 * sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 6) + 0e0) AS share, row_number() OVER (ORDER BY sum(o_totalprice) DESC) AS place FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def top_share_sorted(spark, sf):
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    s = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), n.n_nationkey == c.c_nationkey).groupBy(F.col("n_name").alias("name")).agg(F.sum("o_totalprice").alias("v"))
    return s.select("name", rounded(100 * F.col("v") / F.sum("v").over(Window.partitionBy())).alias("share"), F.row_number().over(Window.orderBy(F.desc("v"))).cast("long").alias("place"))
