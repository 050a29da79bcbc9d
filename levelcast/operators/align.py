"""Alignment of series: equi, nearest, interpolation, priority, cross and range joins.

As-of and interpolation joins are a union of knots and queries and two ordered windows, so
they shuffle once on the series key and never compare all pairs. Every one takes the
partitioning columns ``by``; a single series is one task's sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import round_half_even


def equi(left: DataFrame, *others: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join of two or more series on their keys (month, integer year, name, grid cell)."""
    for other in others:
        left = left.join(other, list(on))
    return left


def yearly_key(t: Column, convention: str = "floor") -> Column:
    """Integer year: ``floor`` of t + 0.01, or ``half_even`` rounding (which merges some half years)."""
    if convention == "floor":
        return F.floor(t + 0.01).cast("int")
    if convention == "half_even":
        return round_half_even(t, 0).cast("int")
    raise ValueError(f"unknown convention {convention!r}")


def left_fill(left: DataFrame, right: DataFrame, on: Sequence[str], fills: dict[str, float]) -> DataFrame:
    """Left join; what is missing becomes a constant."""
    joined = left.join(right, list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def left_fill_median(left: DataFrame, right: DataFrame, on: Sequence[str], column: str, by: Sequence[str] = ()) -> DataFrame:
    """Left join; what is missing becomes the median of what is there (per ``by``)."""
    joined = left.join(right, list(on), "left")
    if not by:
        middle = joined.agg(F.median(column).alias("_m"))
        return joined.crossJoin(F.broadcast(middle)).withColumn(column, F.coalesce(column, "_m")).drop("_m")
    middle = joined.groupBy(*by).agg(F.median(column).alias("_m"))
    return joined.join(middle, list(by)).withColumn(column, F.coalesce(column, "_m")).drop("_m")


def _bracketed(queries: DataFrame, knots: DataFrame, x: str, values: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Queries with ``_lo`` and ``_hi``: the knots (x, values) at or before and at or after them."""
    knot = F.struct(F.col(x).alias("at__"), *[F.col(v).alias(v) for v in values])
    marked = knots.filter(F.col(x).isNotNull()).select(*by, F.col(x).alias("_x"), knot.alias("_k"), F.lit(None).cast(queries.select(F.struct("*")).schema[0].dataType).alias("_q"))
    asked = queries.select(*by, F.col(x).alias("_x"), F.lit(None).cast(marked.schema["_k"].dataType).alias("_k"), F.struct("*").alias("_q"))
    every = marked.unionByName(asked)
    before = Window.partitionBy(*by).orderBy(F.col("_x"), F.col("_q").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy(F.col("_x").desc(), F.col("_q").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    out = every.withColumn("_lo", F.last("_k", ignorenulls=True).over(before)).withColumn("_hi", F.last("_k", ignorenulls=True).over(after))
    return out.filter("_q is not null").select("_q.*", "_lo", "_hi")


def nearest(queries: DataFrame, knots: DataFrame, x: str, values: Sequence[str], by: Sequence[str] = (), tolerance: float | None = None, prefix: str = "near_") -> DataFrame:
    """Each query with the nearest knot's position and values; of two as near, the earlier.

    With a tolerance, queries whose nearest knot is farther are left out.
    """
    both = _bracketed(queries, knots, x, values, by)
    low = F.col("_lo.at__").isNotNull() & (F.col("_hi.at__").isNull() | (F.col(x) - F.col("_lo.at__") <= F.col("_hi.at__") - F.col(x)))
    pick = F.when(low, F.col("_lo")).otherwise(F.col("_hi"))
    out = both.withColumn("_p", pick).select(*queries.columns, F.col("_p.at__").alias(f"{prefix}{x}"), *[F.col(f"_p.{v}").alias(f"{prefix}{v}") for v in values])
    if tolerance is not None:
        out = out.filter(F.abs(F.col(f"{prefix}{x}") - F.col(x)) <= tolerance)
    return out


def as_of(queries: DataFrame, knots: DataFrame, x: str, values: Sequence[str], by: Sequence[str] = (), forward: bool = False) -> DataFrame:
    """Each query with the values of the last knot at or before it (or the first at or after it)."""
    side = "_hi" if forward else "_lo"
    return _bracketed(queries, knots, x, values, by).select(*queries.columns, *[F.col(f"{side}.{v}").alias(v) for v in values])


def interpolate(queries: DataFrame, knots: DataFrame, x: str, values: Sequence[str], by: Sequence[str] = (), outside: str = "clamp") -> DataFrame:
    """Each query with linearly interpolated values.

    ``outside`` the knots: ``clamp`` holds the end values, ``null`` gives null.
    """
    if outside not in ("clamp", "null"):
        raise ValueError("outside must be 'clamp' or 'null'")
    both = _bracketed(queries, knots, x, values, by)
    part = (F.col(x) - F.col("_lo.at__")) / (F.col("_hi.at__") - F.col("_lo.at__"))
    out = []
    for v in values:
        lo, hi = F.col(f"_lo.{v}"), F.col(f"_hi.{v}")
        inside = F.when(F.col("_hi.at__") == F.col("_lo.at__"), lo).otherwise(lo + part * (hi - lo))
        ends = F.when(F.col("_lo").isNull(), hi).otherwise(lo) if outside == "clamp" else F.lit(None).cast("double")
        out.append(F.when(F.col("_lo").isNull() | F.col("_hi").isNull(), ends).otherwise(inside).alias(v))
    return both.select(*queries.columns, *out)


def lagged_interpolate(queries: DataFrame, knots: DataFrame, lags: DataFrame, x: str, values: Sequence[str], by: Sequence[str] = (), outside: str = "clamp") -> DataFrame:
    """Interpolation at ``x - lag`` for each of a few candidate lags (a column ``lag``)."""
    shifted = queries.crossJoin(F.broadcast(lags)).withColumn("_at", F.col(x)).withColumn(x, F.col(x) - F.col("lag"))
    many = knots.crossJoin(F.broadcast(lags))
    out = interpolate(shifted, many, x, values, [*by, "lag"], outside)
    return out.withColumn(x, F.col("_at")).drop("_at")


def prefer(first: DataFrame, second: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Full outer join: the first source's values where it has any, else the second's."""
    b = second.select(*on, *[F.col(c).alias(f"_b_{c}") for c in columns])
    joined = first.select(*on, *columns).join(b, list(on), "full_outer")
    return joined.select(*on, *[F.coalesce(c, f"_b_{c}").alias(c) for c in columns])


def replicate(df: DataFrame, scenarios: DataFrame) -> DataFrame:
    """A component that does not depend on the scenario, repeated for each (few rows, broadcast)."""
    return df.crossJoin(F.broadcast(scenarios))


def grid(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of two short catalogues (data sets by data sets)."""
    return left.crossJoin(F.broadcast(right))


def within(centres: DataFrame, points: DataFrame, x: str, half_width: float, by: Sequence[str] = (), bins: float | None = None) -> DataFrame:
    """Points within ``half_width`` of each centre (column ``centre``), by equi-join on bins.

    Each point is offered to the three bins around its own, so no pair outside is compared.
    """
    width = bins or half_width
    reach = int(-(-half_width // width))
    c = centres.withColumn("_bin", F.floor(F.col("centre") / width))
    p = points.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(x) / width) - reach, F.floor(F.col(x) / width) + reach)))
    return c.join(p, [*by, "_bin"]).filter(F.abs(F.col(x) - F.col("centre")) <= half_width).drop("_bin")


def semi(df: DataFrame, wanted: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is wanted."""
    return df.join(wanted, list(on), "left_semi")


def anti(df: DataFrame, unwanted: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is missing from another table."""
    return df.join(unwanted, list(on), "left_anti")


def equi_rounded(left: DataFrame, right: DataFrame, x: str, digits: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Inner join on time rounded half to even."""
    key = round_half_even(F.col(x), digits)
    return left.withColumn("_key", key).drop(x).join(right.withColumn("_key", key).drop(x), [*by, "_key"]).withColumnRenamed("_key", x)
