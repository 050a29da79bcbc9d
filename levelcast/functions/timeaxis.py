"""The time axis: decimal years in their four conventions, month keys, grids and resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import col


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without time zone (the session's zone is UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def _year_start(year: Column) -> Column:
    return micros(F.make_timestamp(year.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def decimal_year(ts: Column | str) -> Column:
    """Exact: the year and the part of its microseconds that has passed."""
    ts = col(ts)
    a, b = _year_start(F.year(ts)), _year_start(F.year(ts) + 1)
    return F.year(ts) + (micros(ts) - a) / (b - a)


def from_decimal_year(t: Column | str) -> Column:
    """Inverse of ``decimal_year``, to the microsecond."""
    t = col(t)
    a, b = _year_start(F.floor(t)), _year_start(F.floor(t) + 1)
    return F.timestamp_micros(a + F.round((t - F.floor(t)) * (b - a)).cast("long"))


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def decimal_year_by_day(ts: Column | str) -> Column:
    """By day of year: year + (day - 1) / 365 or 366."""
    ts = col(ts)
    return F.year(ts) + (F.dayofyear(ts) - 1) / F.when(is_leap(F.year(ts)), 366.0).otherwise(365.0)


def decimal_year_by_month(ts: Column | str) -> Column:
    """By month and day: year + (month - 1) / 12 + (day - 1) / 365.25."""
    ts = col(ts)
    return F.year(ts) + (F.month(ts) - 1) / 12.0 + (F.dayofmonth(ts) - 1) / 365.25


def decimal_year_mid_month(ts: Column | str) -> Column:
    """The middle of the month: year + (month - 0.5) / 12."""
    ts = col(ts)
    return F.year(ts) + (F.month(ts) - 0.5) / 12.0


def to_month_start(df: DataFrame, ts: str, by: list[str] | None = None) -> DataFrame:
    """Month keys; of several rows of a month the earliest is kept."""
    w = Window.partitionBy(*(by or []), "month").orderBy(ts)
    return df.withColumn("month", F.date_trunc("month", F.col(ts))).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def resolution_months(df: DataFrame, ts: str, by: list[str]) -> DataFrame:
    """Median gap of each series as 1, 3, 6 or 12 months (cuts at 1.5, 4.5 and 9); 1 for a single row."""
    gap = F.datediff(F.col(ts), F.lag(ts).over(Window.partitionBy(*by).orderBy(ts)))
    g = F.median("gap") / 30.44
    months = F.when(g < 1.5, 1).when(g < 4.5, 3).when(g < 9, 6).when(g >= 9, 12).otherwise(1)
    return df.withColumn("gap", gap).groupBy(*by).agg(months.alias("resolution_months"))


def month_grid(df: DataFrame, ts: str, by: list[str]) -> DataFrame:
    """Every month start from a series' first to its last row."""
    ends = df.groupBy(*by).agg(F.date_trunc("month", F.min(ts)).alias("a"), F.date_trunc("month", F.max(ts)).alias("b"))
    return ends.select(*by, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
