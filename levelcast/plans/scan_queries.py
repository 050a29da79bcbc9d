"""Queries of binary and archive scans: cells and lines of the given tables are written in a format and read back by its source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, paths, quantiles
from ..sources import runs, scans, store, tables
from ..sources.scratch import shared_folder
from . import fixtures as X
from .fixtures import CELLS, ENS, r, rounded
from .registry import register, table

_GRID = ["depth", "lat", "lon"]


def _cell_means(spark, sf):
    """One value per year and cell of the line items' grid, and a second variable."""
    cells = X.cells(spark, sf).withColumn("depth", F.col("depth").cast("double"))
    return cells.groupBy("year", *_GRID).agg(F.avg("value").alias("value"), F.sum("weight").alias("weight"))


@register(
    "scan_grid_region",
    f"""WITH {CELLS}, c AS (SELECT year, depth, lat, lon, avg(value) AS value FROM cells GROUP BY 1, 2, 3, 4)
 SELECT year, {r("sum(value * cos(radians(lat))) / sum(cos(radians(lat)))")} AS mean, count(*) AS n FROM c WHERE depth >= 2 AND depth <= 5 AND lat > -60 AND lon < 200 GROUP BY 1""",
)
def scan_grid_region(spark, sf):
    """A region of a grid that is stored as a file per year; bounds of coordinates and the unused variable stay out of the scan."""
    folder = shared_folder(spark, "grid")
    scans.write_cells(_cell_means(spark, sf), folder, ["year"], _GRID, {"value": {"units": "degC"}, "weight": {"kind": "f4"}}, "field-{}")
    cells = scans.cells(spark, folder, [*_GRID, "value", "file"]).filter("depth >= 2 AND depth <= 5 AND lat > -60 AND lon < 200 AND value IS NOT NULL")
    cells = cells.withColumn("year", F.regexp_extract("file", r"field-(\d+)\.nc$", 1).cast("int"))
    out = aggregate.weighted_mean(cells, "value", F.cos(F.radians("lat")), ["year"]).join(cells.groupBy("year").agg(F.count(F.lit(1)).alias("n")), "year")
    return out.select("year", rounded("mean").alias("mean"), "n")


@register(
    "scan_sample_cube",
    f"""WITH {ENS}, c AS (SELECT component, scenario, sample_id, year, round(value * 1000) / 1000 AS value FROM ens)
 SELECT component, scenario, year, {r("quantile_cont(value, 0.05)", 7)} AS p05, {r("quantile_cont(value, 0.5)", 7)} AS p50, {r("quantile_cont(value, 0.95)", 7)} AS p95, {r("avg(value)", 5)} AS mean, count(*) AS n FROM c GROUP BY 1, 2, 3""",
)
def scan_sample_cube(spark, sf):
    """Samples by years, a file per component and scenario with whole millimetres in records; component and scenario come of the names."""
    folder = shared_folder(spark, "samples")
    ens = X.ensemble(spark, sf).select("component", "scenario", F.col("sample_id").cast("double").alias("samples"), F.col("year").cast("double").alias("years"), "value")
    scans.write_cells(ens, folder, ["component", "scenario"], ["samples", "years"], {"value": {"kind": "i4", "scale_factor": 0.001}}, "total-{}-{}_globalsl", record=True)
    long = scans.cells(spark, folder, ["samples", "years", "value", "file"], split_bytes=1 << 16).filter("value IS NOT NULL")
    name = r"total-([^-]+)-([^-]+)_globalsl\.nc$"
    long = long.select(F.regexp_extract("file", name, 1).alias("component"), F.regexp_extract("file", name, 2).alias("scenario"), F.col("years").cast("int").alias("year"), "value")
    out = aggregate.quantile_summary(long, "value", ["component", "scenario", "year"])
    return out.select("component", "scenario", "year", *[rounded(c, 7).alias(c) for c in ("p05", "p50", "p95")], rounded("mean", 5).alias("mean"), "n")


@register(
    "scan_archive_region",
    f"""WITH c AS (SELECT date_trunc('month', l_shipdate) AS m, (l_partkey % 18 * 10 - 85)::DOUBLE AS lat, (l_suppkey % 36 * 10)::DOUBLE AS lon, l_linenumber AS depth, avg(l_extendedprice) / 1e4 AS value FROM lineitem GROUP BY ALL),
 d AS (SELECT year(m) + (month(m) - 0.5) / 12.0::DOUBLE AS t, lat, lon, avg(value) AS v FROM c WHERE lat BETWEEN -30 AND 80 AND (lon >= 285 OR lon <= 100) AND depth BETWEEN 2 AND 5 GROUP BY 1, 2, 3),
 s AS (SELECT t, sum(v * cos(radians(lat))) / sum(cos(radians(lat))) AS mean, sqrt(greatest(sum(v * v * cos(radians(lat))) / sum(cos(radians(lat))) - (sum(v * cos(radians(lat))) / sum(cos(radians(lat)))) ** 2, 0)) AS std FROM d GROUP BY 1)
 SELECT {r("t", 6)} AS t, {r("mean - (SELECT avg(mean) FROM s WHERE t >= 1993 AND t < 1997)", 5)} AS mean, {r("std", 5)} AS std FROM s""",
)
def scan_archive_region(spark, sf):
    """Monthly fields, members of an archive per year: depth mean of each cell, area-weighted mean and deviation, less a baseline."""
    folder = shared_folder(spark, "archives")
    cells = table(spark, sf, "lineitem").groupBy(
        F.year("l_shipdate").alias("year"), F.date_format("l_shipdate", "yyyyMM").alias("month"), (F.col("l_partkey") % 18 * 10 - 85).cast("double").alias("lat"),
        (F.col("l_suppkey") % 36 * 10).cast("double").alias("lon"), F.col("l_linenumber").cast("double").alias("depth"),
    ).agg((F.avg("l_extendedprice") / 1e4 + 273.15).alias("temperature"))
    scans.write_archives(cells, folder, "year", "month", _GRID, {"temperature": {"units": "K"}}, "analyses.{}", "field.{}")
    read = scans.cells(spark, folder, [*_GRID, "temperature", "file"], match=r"!field\.\d{6}\.nc$").filter("temperature IS NOT NULL")
    month = F.regexp_extract("file", r"!field\.(\d{6})\.nc$", 1)
    read = read.withColumn("decimal_year", F.substring(month, 1, 4).cast("int") + (F.substring(month, 5, 2).cast("int") - 0.5) / 12)
    out = tables.ocean_temperature(read, (-30, 80), (-75, 100), (2, 5), reference=(1993, 1997), kelvin=True)
    return out.select(rounded("decimal_year", 6).alias("t"), rounded("mean", 5).alias("mean"), rounded("std", 5).alias("std"))


@register("scan_archive_lines", "SELECT o_orderpriority AS series, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def scan_archive_lines(spark, sf):
    """Orders as compressed lines, a folder per priority, read back line by line."""
    folder = shared_folder(spark, "lines")
    o = table(spark, sf, "orders").select(F.concat_ws("|", "o_orderkey", "o_orderpriority", "o_orderstatus").alias("value"), F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]+", "_").alias("part"))
    o.write.partitionBy("part").option("compression", "gzip").text(folder)
    f = scans.members(spark, folder, r"\.gz!").select(F.split("value", r"\|").alias("f"))
    return f.groupBy(F.get("f", F.lit(1)).alias("series")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.get("f", F.lit(2)) == "F").alias("done"), F.sum(F.get("f", F.lit(0)).cast("long")).alias("keys"))


def _interpolated(asked: str, knots: str, by: str) -> str:
    """SQL of ``asked`` (by..., t) with v of ``knots`` interpolated, ends held."""
    return f"""SELECT * EXCLUDE (lo, lv, hi, hv), CASE WHEN lo IS NULL THEN hv WHEN hi IS NULL OR hi = lo THEN lv ELSE lv + (t - lo) / (hi - lo) * (hv - lv) END AS v FROM (
   SELECT a.*, max(k.t) FILTER (k.t <= a.t) AS lo, arg_max(k.v, k.t) FILTER (k.t <= a.t) AS lv, min(k.t) FILTER (k.t >= a.t) AS hi, arg_min(k.v, k.t) FILTER (k.t >= a.t) AS hv FROM {asked} a JOIN {knots} k USING ({by}) GROUP BY ALL)"""


_EXPERIMENTS = {0: "ctrl", 1: "exp05", 2: "exp07", 3: "exp08"}


@register(
    "scan_run_tree",
    f"""WITH e AS (SELECT event_type AS g, 'm' || (user_id % 3) AS m, user_id % 4 AS k, day(ts) AS d, value FROM events),
 c AS (SELECT g, m, d::DOUBLE AS t, avg(value) AS cv FROM e WHERE k = 0 GROUP BY 1, 2, 3),
 x AS (SELECT g, m, k, ((d - 1) // 2 * 2 + 1.5)::DOUBLE AS t, avg(value) AS v FROM e WHERE k > 0 GROUP BY 1, 2, 3, 4),
 q AS (SELECT g, m, k, t, cv FROM (SELECT DISTINCT g, m, k FROM x) JOIN c USING (g, m)),
 a AS (SELECT g, m, k, t, v - cv AS v FROM ({_interpolated("q", "x", "g, m, k")})),
 f AS (SELECT k, min((g, m)) AS first FROM a GROUP BY 1), w AS (SELECT DISTINCT a.k, t FROM a JOIN f ON a.k = f.k AND (a.g, a.m) = f.first),
 z AS (SELECT g, m, k, t FROM (SELECT DISTINCT g, m, k FROM a) JOIN w USING (k)),
 s AS ({_interpolated("z", "a", "g, m, k")}), b AS (SELECT *, v - min_by(v, abs(t - 10) * 100 + t) OVER (PARTITION BY g, m, k) AS u FROM s)
 SELECT CASE k WHEN 1 THEN 'exp05' WHEN 2 THEN 'exp07' ELSE 'exp08' END AS experiment, t, {r("quantile_cont(u, 0.05)")} AS p05, {r("quantile_cont(u, 0.5)")} AS p50, {r("quantile_cont(u, 0.95)")} AS p95, count(*) AS n, 1::BIGINT AS unreadable FROM b GROUP BY k, t""",
)
def scan_run_tree(spark, sf):
    """Runs in a tree of groups, models and experiments, one file of them damaged: each less its control, on one grid, statistics over models."""
    folder = shared_folder(spark, "runs")
    kind, day = F.col("user_id") % 4, F.dayofmonth("ts")
    t = F.when(kind == 0, day.cast("double")).otherwise(F.floor((day - 1) / 2) * 2 + 1.5)
    name = F.element_at(F.array(*[F.lit(n) for n in _EXPERIMENTS.values()]), (kind + 1).cast("int"))
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("group"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), name.alias("experiment"), t.alias("time")).agg(F.avg("value").alias("ivaf"))
    scans.write_cells(e, folder, list(runs.KEYS), ["time"], {"ivaf": {"units": "m3"}}, "{0}/{1}/{2}/computed_ivaf_{0}_{1}_{2}")
    scans.put(f"{folder}/click/m0/exp09/computed_ivaf_click_m0_exp09.nc", [b"CDF\x01 cut short"])
    members = runs.less_control(runs.cells(spark, folder, ["time", "ivaf"]), "ivaf", "time", F.col("experiment") == "ctrl")
    out = runs.ensemble_stats(members, "ivaf", "time", 10.0)
    lost = runs.catalogue(spark, folder).filter("problem IS NOT NULL").agg(F.count(F.lit(1)).alias("unreadable"))
    out = out.join(F.broadcast(lost))
    return out.select("experiment", F.col("time").alias("t"), *[rounded(c).alias(c) for c in ("p05", "p50", "p95")], "n", "unreadable")


@register(
    "store_replaced_scenario",
    f"""WITH {ENS}, p AS (SELECT component, scenario, value * CASE WHEN component = 'c1' AND scenario = 'click' THEN 3 ELSE 1 END AS value, 'stored' AS origin FROM ens WHERE component <> 'c2'
   UNION ALL SELECT 'c2', s.scenario, value, 'repeated' FROM ens, (SELECT DISTINCT scenario FROM ens) s WHERE component = 'c2' AND ens.scenario = 'click')
 SELECT component, scenario, count(*) AS n, {r("avg(value)")} AS mean, {r("max(value)")} AS most, CASE component WHEN 'c1' THEN 2 ELSE 1 END::BIGINT AS posteriors, 4::BIGINT AS version FROM p GROUP BY ALL""",
)
def store_replaced_scenario(spark, sf):
    """Three components stored; then one scenario of one is replaced with its posteriors; one component is the same in all scenarios."""
    root = shared_folder(spark, "store")
    ens = X.ensemble(spark, sf)
    own = lambda c: ens.filter(F.col("component") == c).drop("component")
    draws = lambda n: spark.range(n).selectExpr("id AS draw", "'a' AS param", "0.1D * id AS value")
    store.replace(spark, root, "c0", {"order": 2, "r2": float("nan")}, draws(1), projections=own("c0"))
    store.replace(spark, root, "c1", {"order": 1}, draws(1), projections=own("c1"))
    store.replace(spark, root, "c2", {"scenario_independent": True}, draws(1), projections=own("c2").filter("scenario = 'click'"))
    version = store.replace(spark, root, "c1", posteriors=draws(2), projections=own("c1").filter("scenario = 'click'").withColumn("value", F.col("value") * 3))
    counts = [(c, store.load(spark, root, c, "posteriors").count()) for c in ("c0", "c1", "c2")]
    out = store.projections(spark, root).groupBy("component", "scenario").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    out = out.join(F.broadcast(spark.createDataFrame(counts, "component string, posteriors long")), "component")
    return out.select("component", "scenario", "n", rounded("mean").alias("mean"), rounded("most").alias("most"), "posteriors", F.lit(version).cast("long").alias("version"))


#: Of suppliers come 2,000 samples at scale 0.1: with seven components, four scenarios and 201 years the reference's whole ensemble of 11.3 million values.
_WORLD = """w AS (SELECT s_suppkey * 2 + side.range AS sample_id, scenario.range AS scenario, year.range::INT AS year,
   ((1 - 2 * side.range) * (s_acctbal / 1e4 - 0.45) * (component.range + 1) + ((s_suppkey * 7919 * (component.range + 3)) % 1009) / 1009.0::DOUBLE * (scenario.range + 1)) * (year.range - 1950) / 200.0::DOUBLE AS value
   FROM supplier, range(2) side, range(7) component, range(4) scenario, range(1950, 2151) year)"""


@register(
    "ensemble_total_quantiles",
    f"""WITH {_WORLD}, t AS (SELECT scenario, year, sample_id, sum(value) AS value FROM w GROUP BY 1, 2, 3)
 SELECT scenario::INT AS scenario, year, {r("quantile_cont(value, 0.05)")} AS p05, {r("quantile_cont(value, 0.5)")} AS p50, {r("quantile_cont(value, 0.95)")} AS p95, count(*) AS n FROM t GROUP BY 1, 2""",
)
def ensemble_total_quantiles(spark, sf):
    """Totals of seven components, sample by sample, and their quantiles by scenario and year, in buckets that bound what a task holds."""
    numbers = lambda n, start=0: F.explode(F.sequence(F.lit(start), F.lit(start + n - 1)))
    w = paths.dealt(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")).select("s_suppkey", "s_acctbal", numbers(2).alias("side")).withColumn("scenario", numbers(4)).withColumn("year", numbers(201, 1950)).withColumn("component", numbers(7))
    value = (1 - 2 * F.col("side")) * (F.col("s_acctbal") / 1e4 - 0.45) * (F.col("component") + 1)
    value = (value + (F.col("s_suppkey") * 7919 * (F.col("component") + 3)) % 1009 / 1009 * (F.col("scenario") + 1)) * (F.col("year") - 1950) / 200
    w = w.select("scenario", "year", (F.col("s_suppkey") * 2 + F.col("side")).alias("sample_id"), value.alias("value"))
    totals = aggregate.component_sum(w, "value", ["scenario", "year", "sample_id"])
    out = quantiles.exact_quantiles(totals, "value", ["scenario", "year"], {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return out.select("scenario", "year", *[rounded(c).alias(c) for c in ("p05", "p50", "p95")], "n")
