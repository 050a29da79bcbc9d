"""Text, CSV and fixed-width readers of observation tables, in DataFrame expressions.

Every reader takes a path that Spark can read, fixes its schema, turns missing-data marks to
null, skips rows that cannot be read, and gives metres, degrees and decimal years with a
positive sign for a rise. Readers of formats without a library here (spreadsheets, NetCDF,
HDF5) take the same tables exported as CSV or Parquet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as S
from ..functions import timeaxis as A
from ..functions import units as U

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _num(c: Column) -> Column:
    return c.try_cast("double")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and place: ``value``, ``file``, ``pos`` (one file per task; such files are small)."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("pos", "value")).filter("trim(value) != ''")


def _fields(df: DataFrame, pattern: str = r"\s+") -> DataFrame:
    return df.withColumn("f", F.split(F.trim("value"), pattern))


def _at(i: int) -> Column:
    """Field ``i`` (from 0) as a number, null if it is missing."""
    return _num(F.get("f", F.lit(i)))


def _after(df: DataFrame, mark: str, skip: int = 1) -> DataFrame:
    """Lines beyond the first that contains ``mark`` and ``skip - 1`` more; all if there is none."""
    first = F.min(F.when(F.col("value").contains(mark), F.col("pos"))).over(Window.partitionBy("file"))
    return df.withColumn("_m", first).filter(F.col("_m").isNull() | (F.col("pos") >= F.col("_m") + skip)).drop("_m")


def altimetry_level(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace table beyond ``Header_End``, at least 12 fields, millimetres."""
    f = _fields(_after(_lines(spark, path), "Header_End")).filter((F.size("f") >= 12) & _at(2).isNotNull())
    out = f.select(_at(2).alias("decimal_year"), *[(_at(i) / 1000).alias(n) for i, n in ((5, "gmsl_nogia"), (8, "gmsl"), (9, "gmsl_sigma"), (11, "gmsl_smoothed"))])
    return out.withColumn("time", A.from_decimal_year("decimal_year"))


BUDGET = ("gmsl", "steric", "glaciers", "greenland", "antarctica", "tws", "sum_contributors", "reservoir", "groundwater", "tws_natural", "altimetry")


def budget_reconstruction(spark: SparkSession, path: str) -> DataFrame:
    """CSV export: year, then mean, lower, upper of eleven terms in millimetres; sigma from the 90 % interval; 1 July."""
    df = spark.read.csv(path, header=True)
    old = df.columns
    out = [F.make_timestamp(_num(F.col(f"`{old[0]}`")).cast("int"), F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("time"), _num(F.col(f"`{old[0]}`")).cast("int").alias("year")]
    for i, name in enumerate(BUDGET):
        if 3 * i + 3 < len(old):
            mid, low, high = (_num(F.col(f"`{old[3 * i + k]}`")) / 1000 for k in (1, 2, 3))
            out += [mid.alias(name), low.alias(f"{name}_lower"), high.alias(f"{name}_upper"), S.sigma_from_interval(low, high).alias(f"{name}_sigma")]
    return df.select(*out).filter("year is not null")


def filled_reconstruction(df: DataFrame, columns: Sequence[str], scale: float = 0.001) -> DataFrame:
    """Exported vectors with fill values (over 1e20) as null; a column that is missing is null."""
    return df.select("decimal_year", *[(S.null_if_huge(F.col(c)) * scale if c in df.columns else F.lit(None).cast("double")).alias(c) for c in columns])


def satellite_budget(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """CSV beyond a line ``data`` and the one after it: decimal year, then value and sigma pairs in millimetres; -999 and below null."""
    f = _fields(_after(_lines(spark, path), "data", 2), ",").filter(_at(0).isNotNull())
    out = [_at(0).alias("decimal_year")]
    for i, n in enumerate(names):
        out += [(S.null_if_at_most(_at(2 * i + 1), -999) / 1000).alias(n), (S.null_if_at_most(_at(2 * i + 2), -999) / 1000).alias(f"{n}_sigma")]
    return f.select(*out)


def assessed_level(spark: SparkSession, path: str) -> DataFrame:
    """CSV: year, central, 17 % and 83 % level in metres; sigma is half the interval."""
    df = spark.read.csv(path, header=True, encoding="UTF-8")
    y, m, lo, hi = (_num(F.col(f"`{c}`")) for c in df.columns[:4])
    return df.select(y.cast("int").alias("year"), m.alias("gmsl"), lo.alias("gmsl_lower"), hi.alias("gmsl_upper"), ((hi - lo) / 2).alias("gmsl_sigma"), (y + 0.5).alias("decimal_year")).filter("year is not null")


def monthly_temperature(spark: SparkSession, path: str, comment: str = "%") -> DataFrame:
    """Comments skipped; year, month, temperature, 95 % half-width; the first of the month."""
    f = _fields(_lines(spark, path).filter(~F.trim("value").startswith(comment))).filter(_at(0).isNotNull() & _at(1).between(1, 12))
    out = f.select(F.make_timestamp(_at(0).cast("int"), _at(1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("time"), S.finite(_at(2)).alias("temperature"), S.finite(_at(3)).alias("temperature_unc"))
    return out.withColumn("temperature_sigma", F.col("temperature_unc") / C.Z_95)


def interval_temperature(spark: SparkSession, path: str) -> DataFrame:
    """CSV: time (YYYY-MM or YYYY), anomaly, lower, upper; the half-width is a 95 % bound."""
    df = spark.read.csv(path, header=True)
    t, v, lo, hi = (F.col(f"`{c}`") for c in df.columns[:4])
    half = (_num(hi) - _num(lo)) / 2
    stamp = F.to_timestamp(F.when(F.length(t) == 4, F.concat(t, F.lit("-07-01"))).otherwise(F.concat(t, F.lit("-01"))), "yyyy-MM-dd")
    return df.select(stamp.alias("time"), _num(v).alias("temperature"), half.alias("temperature_unc"), (half / C.Z_95).alias("temperature_sigma")).filter("time is not null")


def wide_months(df: DataFrame, year: str, months: Sequence[str], value: str, day: int = 1) -> DataFrame:
    """A row per year with twelve month columns, to a row per month in order; what is not a number is null."""
    long = df.select(F.col(year).try_cast("int").alias("year"), *[F.col(m).cast("string").alias(m) for m in months]).filter("year is not null").unpivot(["year"], list(months), "month", value)
    number = F.array_position(F.array(*[F.lit(m) for m in months]), F.col("month")).cast("int")
    return long.select(F.make_timestamp(F.col("year"), number, F.lit(day), F.lit(0), F.lit(0), F.lit(0)).alias("time"), _num(F.col(value)).alias(value)).orderBy("time")


def wide_temperature(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a title line, then Year, Jan .. Dec; ``***`` is missing."""
    f = _fields(_lines(spark, path), ",").filter(_at(0).isNotNull() & (F.size("f") >= 13))
    wide = f.select(F.get("f", F.lit(0)).alias("Year"), *[F.get("f", F.lit(i + 1)).alias(m) for i, m in enumerate(MONTHS)])
    return wide_months(wide, "Year", MONTHS, "temperature")


def annual_temperature(spark: SparkSession, path: str) -> DataFrame:
    """CSV of year and temperature, ``#`` comments; 1 July."""
    f = _fields(_lines(spark, path).filter("not trim(value) like '#%'"), ",").filter(_at(0).isNotNull())
    return f.select(F.make_timestamp(_at(0).cast("int"), F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("time"), _at(1).alias("temperature"))


def ice_mass(spark: SparkSession, path: str, flip: bool = True) -> DataFrame:
    """CSV: year, balance, its error, cumulative, its error. Gigatonnes gained (flipped to a rise), or millimetres of rise."""
    df = spark.read.csv(path, header=True)
    t, r, rs, m, ms = (_num(F.col(f"`{c}`")) for c in df.columns[:5])
    k = -C.GT_TO_M if flip else 0.001
    return df.select(t.alias("decimal_year"), (r * k).alias("mass_balance_rate"), (F.abs(rs) * abs(k)).alias("mass_balance_rate_sigma"), (m * k).alias("cumulative_mass_balance"), (F.abs(ms) * abs(k)).alias("cumulative_mass_balance_sigma")).filter("decimal_year is not null").withColumn("time", A.from_decimal_year("decimal_year"))


def ice_discharge(spark: SparkSession, path: str, first_year: int | None = None) -> DataFrame:
    """CSV of year and, in gigatonnes, balance, surface balance, discharge (and basal term) with errors; gains are flipped, discharge is not.

    Each file is a series of its own.
    """
    df = spark.read.csv(path, header=True)
    names = ("mb", "smb", "discharge", "bmb")
    c = [_num(F.col(f"`{x}`")) for x in df.columns]
    out = [F.input_file_name().alias("_file"), (F.floor(c[0]) + 0.5).alias("decimal_year")]
    for i, n in enumerate(names):
        if 2 * i + 2 < len(c):
            out += [(c[2 * i + 1] * (C.GT_TO_M if n in ("discharge", "bmb") else -C.GT_TO_M)).alias(f"{n}_rate"), (F.abs(c[2 * i + 2]) * C.GT_TO_M).alias(f"{n}_rate_sigma")]
    rows = df.select(*out).filter("decimal_year is not null")
    if first_year is not None:
        rows = rows.filter(F.col("decimal_year") >= first_year)
    w = Window.partitionBy("_file").orderBy("decimal_year").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cumulative_mb", F.sum("mb_rate").over(w)).withColumn("cumulative_mb_sigma", F.sqrt(F.sum(F.col("mb_rate_sigma") ** 2).over(w))).drop("_file")


def glacier_mass(spark: SparkSession, path: str) -> DataFrame:
    """CSV files by region: start, end, area, gigatonnes and metres of water with errors; the middle year; the region from the file's name."""
    df = spark.read.csv(path, header=True).withColumn("region", F.regexp_extract(F.input_file_name(), r"([^/_]+)\.csv$", 1))
    n = {c: _num(F.col(c)) for c in ("start_dates", "end_dates", "glacier_area", "combined_gt", "combined_gt_errors", "combined_mwe", "combined_mwe_errors")}
    return df.select("region", ((n["start_dates"] + n["end_dates"]) / 2).alias("decimal_year"), U.gt_to_m(-n["combined_gt"]).alias("mass_balance"), U.gt_to_m(F.abs(n["combined_gt_errors"])).alias("mass_balance_sigma"), (-n["combined_mwe"]).alias("mass_balance_mwe"), F.abs(n["combined_mwe_errors"]).alias("mass_balance_mwe_sigma"), n["glacier_area"].alias("glacier_area"))


def scenario_temperature(spark: SparkSession, path: str) -> DataFrame:
    """CSV files ``tas_global_<scenario>.csv``: year, 5 %, mean, 95 %; the scenario from the file's name."""
    df = spark.read.csv(path, header=True)
    y, lo, mid, hi = (_num(F.col(f"`{c}`")) for c in df.columns[:4])
    name = F.lower(F.regexp_replace(F.regexp_extract(F.input_file_name(), r"tas_global_([^/.]+(?:\.[0-9]+)*)\.csv$", 1), "[_.-]", ""))
    return df.select(name.alias("scenario"), (y + 0.5).alias("decimal_year"), mid.alias("temperature"), lo.alias("temperature_lower"), hi.alias("temperature_upper"), S.sigma_from_interval(lo, hi).alias("temperature_sigma")).filter("decimal_year is not null")


def thermosteric_yearly(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace table of year, millimetres and error."""
    return _fields(_lines(spark, path)).filter(_at(0).isNotNull()).select(_at(0).alias("decimal_year"), _at(1).alias("tsl_mm"), _at(2).alias("se_mm"))


def thermosteric_quarterly(spark: SparkSession, path: str, start_year: int = 1955) -> DataFrame:
    """Records of 8 characters, four a year: centimetres to millimetres, -999.999 null and left out; the middle of February, May, August, November.

    The depth range comes from the file's name.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "[\r\n]", "").alias("value"))
    return quarterly_records(whole.select(F.regexp_extract("file", r"([0-9]+-[0-9]+)", 1).alias("depth"), "value"), start_year)


def quarterly_records(whole: DataFrame, start_year: int = 1955) -> DataFrame:
    """Records of rows (depth, value), each value a whole file without line ends."""
    n = (F.length("value") / 8).cast("int")
    rec = whole.select("depth", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("value"), i * 8 + 1, F.lit(8)))).alias("i", "v"))
    value = S.null_if_equal(_num(F.trim("v")), -999.999)
    return rec.select("depth", F.make_timestamp(start_year + F.floor(F.col("i") / 4).cast("int"), (F.col("i") % 4 * 3 + 2).cast("int"), F.lit(15), F.lit(0), F.lit(0), F.lit(0)).alias("time"), (value * 10).alias("tsl_mm")).filter("tsl_mm is not null")


def transmission(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace table of decimal year and transmission, to optical depth."""
    return _fields(_lines(spark, path)).filter(_at(0).isNotNull() & (_at(1) > 0)).select(_at(0).alias("decimal_year"), S.optical_depth(_at(1)).alias("saod"))


def climate_index(spark: SparkSession, path: str) -> DataFrame:
    """CSV of date and value; -99 and below null."""
    df = spark.read.csv(path, header=True)
    return df.select(F.to_timestamp(F.col(f"`{df.columns[0]}`")).alias("time"), S.null_if_at_most(_num(F.col(f"`{df.columns[1]}`")), -99).alias("value"))


def bimonthly_index(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace table of a year and twelve values; -999 and below null; the 15th."""
    f = _fields(_lines(spark, path)).filter((F.size("f") == 13) & _at(0).between(1800, 2200))
    wide = f.select(F.get("f", F.lit(0)).alias("year"), *[F.get("f", F.lit(i + 1)).alias(m) for i, m in enumerate(MONTHS)])
    out = wide_months(wide, "year", MONTHS, "value", 15)
    return out.withColumn("value", S.null_if_at_most("value", -999))
