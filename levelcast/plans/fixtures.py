"""Series, forcings and ensembles made of the driver's tables, in Spark and in SQL.

``level``: monthly mean order value (metres stand-in) with its standard error; ``forcing``:
monthly mean discount (temperature stand-in) and tax (second forcing); ``ens``: events as an
ensemble of scenario, component, sample and year; ``cells``: line items as grid cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeaxis import decimal_year_by_month
from ..operators.aggregate import exact_mean
from .registry import table


def level(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_trunc("month", "o_orderdate")
    out = table(spark, sf_dir, "orders").groupBy(month.alias("month")).agg((F.avg("o_totalprice") / 1e5).alias("level"), (F.stddev_samp("o_totalprice") / 1e5 / F.sqrt(F.count(F.lit(1)))).alias("sigma"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("t_year", decimal_year_by_month("month"))


def forcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_trunc("month", "l_shipdate")
    out = table(spark, sf_dir, "lineitem").groupBy(month.alias("month")).agg((F.avg("l_discount") * 10).alias("temp"), F.avg("l_tax").alias("saod"))
    return out.withColumn("t_year", decimal_year_by_month("month"))


def regional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level series of each order priority."""
    month = F.date_trunc("month", "o_orderdate")
    out = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), month.alias("month")).agg((F.avg("o_totalprice") / 1e5).alias("level"), (F.stddev_pop("o_totalprice") / 1e5 / F.sqrt(F.count(F.lit(1)))).alias("sigma"))
    return out.withColumn("t_year", decimal_year_by_month("month"))


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("scenario"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("component"), F.floor(F.col("user_id") / 3).alias("sample_id"), (F.lit(2024) + F.floor((F.dayofmonth("ts") - 1) / 10)).cast("int").alias("year")).agg((exact_mean("value") / 97.3).alias("value"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.year("l_shipdate").alias("year"), (F.col("l_partkey") % 18 * 10 - 85).cast("double").alias("lat"), (F.col("l_suppkey") % 36 * 10).cast("double").alias("lon"), F.col("l_linenumber").alias("depth"), (F.col("l_extendedprice") / 1e4).alias("value"), F.col("l_quantity").alias("weight"))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; never minus zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0e0)"


LEVEL = """level AS (SELECT *, year(month) + (month(month) - 1) / 12.0::DOUBLE AS t_year FROM (
  SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, avg(o_totalprice) / 1e5 AS level,
         stddev_samp(o_totalprice) / 1e5 / sqrt(count(*)) AS sigma, count(*) AS n FROM orders GROUP BY 1))"""
FORCING = """forcing AS (SELECT *, year(month) + (month(month) - 1) / 12.0::DOUBLE AS t_year FROM (
  SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS month, avg(l_discount) * 10 AS temp, avg(l_tax) AS saod FROM lineitem GROUP BY 1))"""
REGIONAL = """regional AS (SELECT *, year(month) + (month(month) - 1) / 12.0::DOUBLE AS t_year FROM (
  SELECT o_orderpriority AS series, date_trunc('month', o_orderdate)::TIMESTAMP AS month, avg(o_totalprice) / 1e5 AS level,
         stddev_pop(o_totalprice) / 1e5 / sqrt(count(*)) AS sigma FROM orders GROUP BY 1, 2))"""
ENS = """ens AS (SELECT event_type AS scenario, 'c' || (user_id % 3) AS component, user_id // 3 AS sample_id,
  (2024 + (day(ts) - 1) // 10)::INT AS year, avg(value) / 97.3 AS value FROM events GROUP BY 1, 2, 3, 4)"""
CELLS = """cells AS (SELECT year(l_shipdate)::INT AS year, (l_partkey % 18 * 10 - 85)::DOUBLE AS lat, (l_suppkey % 36 * 10)::DOUBLE AS lon,
  l_linenumber AS depth, l_extendedprice / 1e4 AS value, l_quantity AS weight FROM lineitem)"""
