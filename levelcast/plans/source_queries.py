"""Queries of source layouts (melting, cubes, catalogues, grids) and of the streaming windows in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence
from ..sources import tables, text
from ..streaming import windows
from . import fixtures as X
from .fixtures import ENS, r, rounded
from .registry import register, table


@register("source_melt_months", """WITH w AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY 1, 2)
 SELECT make_timestamp(y, m, 1, 0, 0, 0) AS "time", max(v) AS temperature FROM (SELECT y, m, v FROM w UNION ALL SELECT y.y, mm.range, NULL FROM (SELECT DISTINCT y FROM w) y, range(1, 13) mm) GROUP BY y, m""")
def source_melt_months(spark, sf):
    o = table(spark, sf, "orders").withColumns({"Year": F.year("o_orderdate").cast("string"), "m": F.month("o_orderdate")})
    wide = o.groupBy("Year").pivot("m", list(range(1, 13))).agg(F.round(F.avg("o_totalprice"), 4))
    wide = wide.select("Year", *[F.coalesce(F.col(str(i + 1)).cast("string"), F.lit("***")).alias(m) for i, m in enumerate(text.MONTHS)])
    return text.wide_months(wide, "Year", text.MONTHS, "temperature")


@register("source_json_fields", "SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total, count(*) AS n FROM events GROUP BY 1")
def source_json_fields(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("n"))


@register("source_name_parts", r"""SELECT regexp_extract(s_name, '([A-Za-z]+)#([0-9]+)', 1) AS kind, (regexp_extract(s_name, '([A-Za-z]+)#([0-9]+)', 2)::BIGINT % 7)::BIGINT AS code, count(*) AS n FROM supplier GROUP BY 1, 2""")
def source_name_parts(spark, sf):
    pattern = r"([A-Za-z]+)#([0-9]+)"
    s = table(spark, sf, "supplier")
    return s.groupBy(F.regexp_extract("s_name", pattern, 1).alias("kind"), (F.regexp_extract("s_name", pattern, 2).cast("long") % 7).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@register("source_fixed_width", """WITH x AS (SELECT o_orderpriority AS series, printf('%8.3f', avg(o_totalprice) / 1e3)::DOUBLE AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY date_trunc('quarter', o_orderdate)) - 1 AS i FROM orders GROUP BY 1, date_trunc('quarter', o_orderdate))
 SELECT series AS depth, make_timestamp((1955 + i // 4)::BIGINT, (i % 4 * 3 + 2)::BIGINT, 15, 0, 0, 0) AS "time", (round(v * 10, 4) + 0e0) AS tsl_mm FROM x""")
def source_fixed_width(spark, sf):
    q = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.date_trunc("quarter", "o_orderdate").alias("q")).agg((F.avg("o_totalprice") / 1e3).alias("v"))
    t = q.groupBy(F.col("series").alias("depth")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("q", "v"))), lambda s: F.format_string("%8.3f", s["v"])), "").alias("value"))
    return text.quarterly_records(t).withColumn("tsl_mm", rounded("tsl_mm", 4))


_CUBE = f"""WITH {ENS}, q AS (SELECT (range / 20.0)::DOUBLE AS quantile FROM range(1, 20)), cube AS (SELECT component, scenario, year, quantile, quantile_cont(value, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])[round(quantile * 20)::INT] AS value FROM ens, q GROUP BY 1, 2, 3, 4)"""


def _cube(spark, sf):
    qs = [i / 20 for i in range(1, 20)]
    q = X.ensemble(spark, sf).groupBy("component", "scenario", "year").agg(F.percentile("value", qs).alias("q"))
    return q.select("component", "scenario", "year", F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in qs]).alias("quantile"), F.col("q").alias("value"))).alias("z")).select("component", "scenario", "year", F.col("z.quantile"), F.col("z.value"))


@register("source_quantile_slices", f"""{_CUBE} SELECT component, scenario, year, {r('max(value) FILTER (round(quantile * 20) = 1)')} AS q05, {r('max(value) FILTER (round(quantile * 20) = 3)')} AS q17, {r('max(value) FILTER (round(quantile * 20) = 10)')} AS q50, {r('max(value) FILTER (round(quantile * 20) = 17)')} AS q83, {r('max(value) FILTER (round(quantile * 20) = 19)')} AS q95, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std FROM cube GROUP BY 1, 2, 3""")
def source_quantile_slices(spark, sf):
    out = tables.quantile_component(_cube(spark, sf))
    return out.select("component", "scenario", "year", *[rounded(c).alias(c) for c in ("q05", "q17", "q50", "q83", "q95", "mean", "std")])


@register("source_nearest_year", f"""{_CUBE}, s AS (SELECT component, scenario, year, max(value) FILTER (round(quantile * 20) = 10) AS q50 FROM cube GROUP BY 1, 2, 3) SELECT component, scenario, year, {r('q50')} AS q50 FROM s WHERE year = 2026""")
def source_nearest_year(spark, sf):
    out = tables.nearest_entry(tables.quantile_slices(_cube(spark, sf), [0.5]), 2030.0)
    return out.select("component", "scenario", "year", rounded("q50").alias("q50"))


@register("source_sample_matrix", f"""WITH {ENS} SELECT scenario, sample_id, year, {r('value / 1000', 9)} AS value FROM ens WHERE component = 'c1'""")
def source_sample_matrix(spark, sf):
    e = X.ensemble(spark, sf).filter("component = 'c1'")
    wide = e.groupBy("scenario", "sample_id").pivot("year", [2024, 2025, 2026]).agg(F.first("value"))
    out = tables.samples_long(wide, "sample_id", ["2024", "2025", "2026"], keep=["scenario"]).filter("value is not null")
    return out.select("scenario", "sample_id", "year", rounded("value", 9).alias("value"))


@register("source_scenario_mix", f"""WITH {ENS} SELECT sample_id, year, {r("sum(CASE scenario WHEN 'click' THEN 0.375 ELSE 0.625 END * value)")} AS value FROM ens WHERE component = 'c0' AND scenario IN ('click', 'view') GROUP BY 1, 2""")
def source_scenario_mix(spark, sf):
    e = X.ensemble(spark, sf).filter("component = 'c0'").drop("component")
    out = tables.drawn_samples(e, 10**6, {"mixed": {"click": 0.375, "view": 0.625}}).filter("scenario = 'mixed'")
    ids = e.select("sample_id").distinct()
    from pyspark.sql import Window

    back = ids.select(F.col("sample_id").alias("old"), (F.row_number().over(Window.orderBy(F.xxhash64(F.lit("draw"), F.col("sample_id")), "sample_id")) - 1).alias("sample_id"))
    return out.join(back, "sample_id").select(F.col("old").alias("sample_id"), "year", rounded("value").alias("value"))


@register("source_ice_volume", """WITH v AS (SELECT l_suppkey % 5 AS model, year(l_shipdate)::DOUBLE AS y, sum(l_quantity) * 1e9 AS ivaf FROM lineitem GROUP BY 1, 2) SELECT model, y AS decimal_year, (round(-(ivaf - first_value(ivaf) OVER (PARTITION BY model ORDER BY y)) * 917 / (1028 * 3.625e14), 9) + 0e0) AS level FROM v""")
def source_ice_volume(spark, sf):
    v = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("model"), F.year("l_shipdate").cast("double").alias("decimal_year")).agg((F.sum("l_quantity") * 1e9).alias("ivaf"))
    out = tables.ice_volume_level(v, ["model"], density=F.lit(917.0))
    return out.select("model", "decimal_year", rounded("level", 9).alias("level"))


@register("source_model_ensemble", f"""WITH v AS (SELECT l_suppkey % 20 AS model, year(l_shipdate)::DOUBLE AS y, avg(l_extendedprice) / 1e4 AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT *, v - max(CASE WHEN y = 1998 THEN v END) OVER (PARTITION BY model) AS d FROM v)
 SELECT y, {r('quantile_cont(d, 0.05)')} AS p05, {r('quantile_cont(d, 0.5)')} AS p50, {r('quantile_cont(d, 0.95)')} AS p95, count(*) AS n FROM b GROUP BY 1""")
def source_model_ensemble(spark, sf):
    v = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("model"), F.year("l_shipdate").cast("double").alias("y")).agg((F.avg("l_extendedprice") / 1e4).alias("v"))
    out = tables.model_ensemble_stats(v, ["model"], "y", "v", 1998.0)
    return out.select("y", *[rounded(c).alias(c) for c in ("p05", "p50", "p95")], "n")


@register("source_ensemble_pivot", f"""WITH {ENS}, m AS (SELECT year, component, avg(value) AS v FROM ens GROUP BY 1, 2) SELECT year, {r("max(v) FILTER (component = 'c0')")} AS c0, {r("max(v) FILTER (component = 'c1')")} AS c1, {r("max(v) FILTER (component = 'c2')")} AS c2 FROM m GROUP BY 1""")
def source_ensemble_pivot(spark, sf):
    m = X.ensemble(spark, sf).groupBy("year", "component").agg(F.avg("value").alias("v"))
    out = tables.ensemble_wide(m, "year", "component", "v", ["c0", "c1", "c2"])
    return out.select("year", *[rounded(c).alias(c) for c in ("c0", "c1", "c2")])


@register("source_tidewater_totals", """WITH g AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 0), y AS (SELECT year(l_shipdate)::INT AS year, sum(l_quantity) AS smb, sum(l_quantity * 1.1) AS d FROM lineitem JOIN g ON l_suppkey = s_suppkey GROUP BY 1)
 SELECT year, (round(smb - d, 4) + 0e0) AS mb, (round(sum(smb - d) OVER (ORDER BY year), 4) + 0e0) AS cumulative FROM y""")
def source_tidewater_totals(spark, sf):
    g = table(spark, sf, "supplier").filter("s_acctbal > 0")
    y = table(spark, sf, "lineitem").join(g, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").groupBy(F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("smb"), F.sum(F.col("l_quantity") * 1.1).alias("d"))
    mb = F.col("smb") - F.col("d")
    return y.select("year", rounded(mb, 4).alias("mb"), rounded(F.sum(mb).over(sequence.running("year")), 4).alias("cumulative"))


@register("stream_tumbling_mean", f"""SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_tumbling_mean(spark, sf):
    out = windows.tumbling_mean(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", ["event_type"])
    return out.select("start", "event_type", rounded("mean").alias("mean"), rounded("std").alias("std"), "n")


@register("stream_sliding_mean", f"""SELECT d - INTERVAL (o.range) DAY AS start, event_type, {r('avg(value)')} AS mean, count(*) AS n FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS d, event_type, value FROM events), range(0, 2) o GROUP BY 1, 2""")
def stream_sliding_mean(spark, sf):
    out = windows.sliding_mean(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", ["event_type"])
    return out.select("start", "event_type", rounded("mean").alias("mean"), "n")
