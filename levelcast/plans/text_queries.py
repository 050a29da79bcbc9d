"""Queries of the text readers: series of the given tables are written in each layout, a file per series, and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..sources import scans, text
from ..sources.scratch import shared_folder
from .fixtures import r, rounded
from .registry import register, table

YEARS = "y AS (SELECT year(o_orderdate)::INT AS y, avg(o_totalprice) / 1e5 AS v, stddev_pop(o_totalprice) / 1e5 AS s FROM orders GROUP BY 1)"
MONTHS = "m AS (SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS k, avg(o_totalprice) / 1e5 AS v, stddev_pop(o_totalprice) / 1e5 AS s FROM orders GROUP BY 1, 2)"
KINDS = "p AS (SELECT o_orderpriority AS name, year(o_orderdate)::INT AS y, avg(o_totalprice) / 1e5 AS v, stddev_pop(o_totalprice) / 1e5 AS s FROM orders GROUP BY 1, 2)"


def _means(spark, sf, *keys):
    o = table(spark, sf, "orders").withColumns({"y": F.year("o_orderdate"), "k": F.month("o_orderdate"), "name": F.col("o_orderpriority")})
    return o.groupBy(*keys).agg((F.avg("o_totalprice") / 1e5).alias("v"), (F.stddev_pop("o_totalprice") / 1e5).alias("s"))


def num(c, digits: int = 5):
    """A number as a file has it."""
    return F.format_string(f"%.{digits}f", c)


def n(expr: str, digits: int = 5) -> str:
    """The same number in SQL."""
    return f"printf('%.{digits}f', {expr})::DOUBLE"


def files(rows, label: str, order, line, name=None, head: tuple[str, ...] = (), ending: str = "txt") -> str:
    """The folder of a file per ``name``: the lines of ``head``, then one per row, in order. A series is short."""
    folder = shared_folder(rows.sparkSession, label)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = [*head, *pdf.sort_values("at")["line"]]
        size = scans.put(f"{folder}/{pdf['name'].iloc[0]}.{ending}", [("\n".join(lines) + "\n").encode()])
        return pd.DataFrame({"bytes": [size]})

    places = rows.select((F.lit("all") if name is None else name).alias("name"), sum((F.col(c) * 1000 ** (len(order) - 1 - i) for i, c in enumerate(order)), F.lit(0)).cast("double").alias("at"), line.alias("line"))
    places.groupBy("name").applyInPandas(write, "bytes long").count()
    return folder


def _out(df, names, digits: int = 6, keep: tuple[str, ...] = ()):
    return df.select(*keep, *[rounded(c, digits).alias(c) for c in names])


@register("text_altimetry", f"WITH {MONTHS} SELECT {r(n('y + (k - 0.5) / 12'))} AS decimal_year, {r(n('v * 900') + ' / 1000')} AS gmsl_nogia, {r(n('v * 1000') + ' / 1000')} AS gmsl, {r(n('s') + ' / 1000')} AS gmsl_sigma, {r(n('v * 999') + ' / 1000')} AS gmsl_smoothed FROM m")
def text_altimetry(spark, sf):
    line = F.concat_ws("  ", F.lit("0 999"), num(F.col("y") + (F.col("k") - 0.5) / 12), F.lit("1 1"), num(F.col("v") * 900), F.lit("0 0"), num(F.col("v") * 1000), num("s"), F.lit("0"), num(F.col("v") * 999))
    path = files(_means(spark, sf, "y", "k"), "altimetry", ["y", "k"], line, head=("HDR 1 2 3 4 5 6 7 8 9 10 11", "HDR Header_End"))
    return _out(text.altimetry_level(spark, path), ("decimal_year", "gmsl_nogia", "gmsl", "gmsl_sigma", "gmsl_smoothed"))


@register("text_budget", f"WITH {YEARS} SELECT y AS year, {r(n('v * 1000') + ' / 1000')} AS gmsl, {r(n('v * 11000') + ' / 1000')} AS altimetry, {r('((' + n('v * 2000 + s') + ') - (' + n('v * 2000 - s') + ')) / 1000 / (2 * 1.645)')} AS steric_sigma FROM y")
def text_budget(spark, sf):
    parts = [num(F.col("v") * 1000 * (i + 1) + d * F.col("s")) for i in range(11) for d in (0, -1, 1)]
    path = files(_means(spark, sf, "y"), "budget", ["y"], F.concat_ws(",", "y", *parts), head=("year," + ",".join(f"c{i}" for i in range(33)),), ending="csv")
    return _out(text.budget_reconstruction(spark, path), ("gmsl", "altimetry", "steric_sigma"), keep=("year",))


@register("text_filled_vectors", f"WITH {MONTHS} SELECT {r('y + k / 12.0')} AS decimal_year, CASE WHEN k = 6 THEN NULL ELSE {r('v / 1000', 9)} END AS level, NULL::DOUBLE AS absent FROM m")
def text_filled_vectors(spark, sf):
    df = _means(spark, sf, "y", "k").select((F.col("y") + F.col("k") / 12).alias("decimal_year"), F.when(F.col("k") == 6, 9.96921e36).otherwise(F.col("v")).alias("level"))
    out = text.filled_reconstruction(df, ["level", "absent"])
    return out.select(rounded("decimal_year").alias("decimal_year"), rounded("level", 9).alias("level"), "absent")


@register("text_satellite_budget", f"WITH {MONTHS} SELECT {r(n('y + k / 12.0'))} AS decimal_year, {r(n('v * 10') + ' / 1000', 8)} AS total, CASE WHEN k <> 6 THEN {r(n('s') + ' / 1000', 8)} END AS total_sigma FROM m")
def text_satellite_budget(spark, sf):
    line = F.concat_ws(",", num(F.col("y") + F.col("k") / 12), num(F.col("v") * 10), F.when(F.col("k") == 6, "-999.9").otherwise(num("s")))
    path = files(_means(spark, sf, "y", "k"), "satellite", ["y", "k"], line, head=("1,2,3", "begin of data", "yr,mm,mm"))
    out = text.satellite_budget(spark, path, ["total"])
    return out.select(rounded("decimal_year").alias("decimal_year"), rounded("total", 8).alias("total"), rounded("total_sigma", 8).alias("total_sigma"))


@register("text_assessed_level", f"WITH {YEARS} SELECT y AS year, {r(n('v'))} AS gmsl, {r('(' + n('v + s') + ' - ' + n('v - s') + ') / 2')} AS gmsl_sigma, y + 0.5::DOUBLE AS decimal_year FROM y")
def text_assessed_level(spark, sf):
    line = F.concat_ws(",", "y", num("v"), num(F.col("v") - F.col("s")), num(F.col("v") + F.col("s")))
    out = text.assessed_level(spark, files(_means(spark, sf, "y"), "assessed", ["y"], line, head=("Year,Central,17%,83%",), ending="csv"))
    return _out(out, ("gmsl", "gmsl_sigma"), keep=("year", "decimal_year"))


@register("text_monthly_temperature", f"""WITH {MONTHS} SELECT make_timestamp(y, k, 1, 0, 0, 0) AS "time", CASE WHEN k <> 6 THEN {r(n('v'))} END AS temperature, {r(n('s') + ' / 1.96')} AS temperature_sigma FROM m""")
def text_monthly_temperature(spark, sf):
    line = F.concat_ws("   ", "y", "k", F.when(F.col("k") == 6, "NaN").otherwise(num("v")), num("s"))
    path = files(_means(spark, sf, "y", "k"), "monthly", ["y", "k"], line, head=("% a comment 1 2 3", "%", ""))
    return _out(text.monthly_temperature(spark, path), ("temperature", "temperature_sigma"), keep=("time",))


@register("text_interval_temperature", f"""WITH {MONTHS} SELECT make_timestamp(y, k, 1, 0, 0, 0) AS "time", {r(n('v'))} AS temperature, {r('(' + n('v + s') + ' - ' + n('v - 2 * s') + ') / 2 / 1.96')} AS temperature_sigma FROM m""")
def text_interval_temperature(spark, sf):
    line = F.concat_ws(",", F.format_string("%04d-%02d", "y", "k"), num("v"), num(F.col("v") - 2 * F.col("s")), num(F.col("v") + F.col("s")))
    out = text.interval_temperature(spark, files(_means(spark, sf, "y", "k"), "interval", ["y", "k"], line, head=("Time,Anomaly,Lower,Upper",), ending="csv"))
    return _out(out, ("temperature", "temperature_sigma"), keep=("time",))


_FULL = "f AS (SELECT a.y, k.range::INT AS k, v FROM (SELECT DISTINCT y FROM m) a CROSS JOIN range(1, 13) k LEFT JOIN m ON m.y = a.y AND m.k = k.range)"


def _wide(spark, sf, missing: str):
    wide = _means(spark, sf, "y", "k").groupBy("y").pivot("k", list(range(1, 13))).agg(F.first("v"))
    return wide, [F.coalesce(num(F.col(str(i))), F.lit(missing)) for i in range(1, 13)]


@register("text_wide_temperature", f"""WITH {MONTHS}, {_FULL} SELECT make_timestamp(y, k, 1, 0, 0, 0) AS "time", {r(n('v'))} AS temperature FROM f""")
def text_wide_temperature(spark, sf):
    wide, months = _wide(spark, sf, "***")
    path = files(wide, "wide", ["y"], F.concat_ws(",", "y", *months), head=("Title of the table", "Year," + ",".join(text.MONTHS)))
    return _out(text.wide_temperature(spark, path), ("temperature",), keep=("time",))


@register("text_bimonthly_index", f"""WITH {MONTHS}, {_FULL} SELECT make_timestamp(y, k, 15, 0, 0, 0) AS "time", {r(n('v'))} AS value FROM f""")
def text_bimonthly_index(spark, sf):
    wide, months = _wide(spark, sf, "-999.00")
    path = files(wide, "bimonthly", ["y"], F.concat_ws("  ", "y", *months), head=("1979 2024", "YEAR DJ JF FM"))
    return _out(text.bimonthly_index(spark, path), ("value",), keep=("time",))


@register("text_annual_temperature", f"""WITH {YEARS} SELECT make_timestamp(y, 7, 1, 0, 0, 0) AS "time", {r(n('v'))} AS temperature FROM y""")
def text_annual_temperature(spark, sf):
    path = files(_means(spark, sf, "y"), "annual", ["y"], F.concat_ws(",", "y", num("v")), head=("# Title: 1", "# Units", "Year,Anomaly"))
    return _out(text.annual_temperature(spark, path), ("temperature",), keep=("time",))


@register(
    "text_ice_mass",
    f"""WITH {MONTHS} SELECT {r(n('y + k / 12.0'))} AS decimal_year, {r('-' + n('v * 100') + ' / 362500', 9)} AS mass_balance_rate, {r('abs(' + n('-s * 100') + ') / 362500', 9)} AS mass_balance_rate_sigma,
 {r('-' + n('v * 5000') + ' / 362500', 9)} AS cumulative_mass_balance, {r('abs(' + n('s * 900') + ') / 362500', 9)} AS cumulative_mass_balance_sigma FROM m""",
)
def text_ice_mass(spark, sf):
    line = F.concat_ws(",", num(F.col("y") + F.col("k") / 12), num(F.col("v") * 100), num(-F.col("s") * 100), num(F.col("v") * 5000), num(F.col("s") * 900))
    out = text.ice_mass(spark, files(_means(spark, sf, "y", "k"), "ice", ["y", "k"], line, head=("Year,Rate,Rate error,Cumulative,Cumulative error",), ending="csv"))
    return _out(out, ("decimal_year", "mass_balance_rate", "mass_balance_rate_sigma", "cumulative_mass_balance", "cumulative_mass_balance_sigma"), 9)


@register(
    "text_ice_discharge",
    f"""WITH {KINDS}, d AS (SELECT name, y + 0.5::DOUBLE AS decimal_year, -{n('v * 10')} / 362500 AS mb, {n('s')} / 362500 AS ms, -{n('v * 30')} / 362500 AS smb, {n('v * 20')} / 362500 AS dis FROM p WHERE y >= 1993)
 SELECT decimal_year, {r('mb', 9)} AS mb_rate, {r('smb', 9)} AS smb_rate, {r('dis', 9)} AS discharge_rate, {r('sum(mb) OVER w', 9)} AS cumulative_mb, {r('sqrt(sum(ms * ms) OVER w)', 9)} AS cumulative_mb_sigma FROM d WINDOW w AS (PARTITION BY name ORDER BY decimal_year)""",
)
def text_ice_discharge(spark, sf):
    v, s = F.col("v"), F.col("s")
    line = F.concat_ws(",", "y", num(v * 10), num(s), num(v * 30), num(s), num(v * 20), num(s))
    path = files(_means(spark, sf, "name", "y"), "discharge", ["y"], line, F.col("name"), ("Year,MB,MB error,SMB,SMB error,D,D error",), "csv")
    return _out(text.ice_discharge(spark, path, 1993), ("decimal_year", "mb_rate", "smb_rate", "discharge_rate", "cumulative_mb", "cumulative_mb_sigma"), 9)


@register(
    "text_glacier_mass",
    f"""WITH {KINDS} SELECT regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS region, {r('y + 0.5')} AS decimal_year, {r('-' + n('v * 100') + ' / 362500', 9)} AS mass_balance, {r(n('s * 10') + ' / 362500', 9)} AS mass_balance_sigma,
 {r('-' + n('v'))} AS mass_balance_mwe, {r(n('v * 1000'))} AS glacier_area FROM p""",
)
def text_glacier_mass(spark, sf):
    v, s = F.col("v"), F.col("s")
    line = F.concat_ws(",", "y", F.col("y") + 1, num(v * 1000), num(v * 100), num(s * 10), num(v), num(-s))
    region = F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-")
    head = ("start_dates,end_dates,glacier_area,combined_gt,combined_gt_errors,combined_mwe,combined_mwe_errors",)
    out = text.glacier_mass(spark, files(_means(spark, sf, "name", "y"), "glaciers", ["y"], line, F.concat(F.lit("calendar_"), region), head, "csv"))
    return out.select("region", *[rounded(c, 9 if c.startswith("mass_balance") and "mwe" not in c else 6).alias(c) for c in ("decimal_year", "mass_balance", "mass_balance_sigma", "mass_balance_mwe", "glacier_area")])


@register(
    "text_scenario_temperature",
    f"""WITH e AS (SELECT event_type AS name, (1999 + day(ts))::INT AS y, avg(value) AS v, stddev_pop(value) AS s FROM events GROUP BY 1, 2)
 SELECT name AS scenario, y + 0.5::DOUBLE AS decimal_year, {r(n('v'))} AS temperature, {r('(' + n('v + s') + ' - ' + n('v - s') + ') / (2 * 1.645)')} AS temperature_sigma FROM e""",
)
def text_scenario_temperature(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("name"), (1999 + F.dayofmonth("ts")).alias("y")).agg(F.avg("value").alias("v"), F.stddev_pop("value").alias("s"))
    line = F.concat_ws(",", "y", num(F.col("v") - F.col("s")), num("v"), num(F.col("v") + F.col("s")))
    out = text.scenario_temperature(spark, files(e, "scenarios", ["y"], line, F.concat(F.lit("tas_global_"), F.col("name")), ("Year,5%,Mean,95%",), "csv"))
    return _out(out, ("temperature", "temperature_sigma"), keep=("scenario", "decimal_year"))


@register("text_thermosteric_yearly", f"WITH {YEARS} SELECT (y + 0.5)::DOUBLE AS decimal_year, {r(n('v'))} AS tsl_mm, {r(n('s'))} AS se_mm FROM y")
def text_thermosteric_yearly(spark, sf):
    path = files(_means(spark, sf, "y"), "steric", ["y"], F.concat_ws("  ", F.concat(F.col("y").cast("string"), F.lit(".500")), num("v"), num("s")), head=("YEAR WO WOse",))
    return _out(text.thermosteric_yearly(spark, path), ("tsl_mm", "se_mm"), keep=("decimal_year",))


@register("text_transmission", f"WITH {MONTHS} SELECT {r(n('y + k / 12.0'))} AS decimal_year, {r('-ln(' + n('exp(-v / 10)', 8) + ')')} AS saod FROM m")
def text_transmission(spark, sf):
    line = F.concat_ws("  ", num(F.col("y") + F.col("k") / 12), num(F.exp(-F.col("v") / 10), 8))
    return _out(text.transmission(spark, files(_means(spark, sf, "y", "k"), "transmission", ["y", "k"], line, head=("date  ratio",))), ("decimal_year", "saod"))


@register("text_climate_index", f"""WITH {MONTHS} SELECT make_timestamp(y, k, 1, 0, 0, 0) AS "time", CASE WHEN k <> 6 THEN {r(n('v'))} END AS value FROM m""")
def text_climate_index(spark, sf):
    line = F.concat_ws(",", F.format_string("%04d-%02d-01", "y", "k"), F.when(F.col("k") == 6, "-99.90").otherwise(num("v")))
    return _out(text.climate_index(spark, files(_means(spark, sf, "y", "k"), "index", ["y", "k"], line, head=("Date,Index",), ending="csv")), ("value",), keep=("time",))
