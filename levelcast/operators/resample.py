"""Resampling, baselines, merging and splicing of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeaxis import micros, month_grid
from .align import interpolate, nearest


def annual_mean(df: DataFrame, value: str, t: str = "t_year", by: Sequence[str] = (), least: int = 1, sigma: str | None = None, independent: bool = False) -> DataFrame:
    """Means by calendar year (key year + 0.5) of years with at least ``least`` values.

    Errors: root of the mean square, or (independent) root of the sum of squares over the count.
    """
    aggs = [F.avg(value).alias(value), F.count(value).alias("n")]
    if sigma:
        square = F.col(sigma) * F.col(sigma)
        aggs.append((F.sqrt(F.sum(square)) / F.count(F.lit(1)) if independent else F.sqrt(F.avg(square))).alias(sigma))
    return df.groupBy(*by, F.floor(t).cast("int").alias("year")).agg(*aggs).filter(F.col("n") >= least).withColumn(t, F.col("year") + 0.5)


def annual_last(df: DataFrame, values: Sequence[str], t: str = "t_year", by: Sequence[str] = ()) -> DataFrame:
    """The last row of each year (key year + 0.5)."""
    return df.groupBy(*by, F.floor(t).cast("int").alias("year")).agg(*[F.max_by(v, t).alias(v) for v in values]).withColumn(t, F.col("year") + 0.5)


def in_window(t: str, start: float, end: float, inclusive: str = "left"):
    """Whether a time lies in a window; inclusive: left, right, both or neither."""
    if inclusive not in ("left", "right", "both", "neither"):
        raise ValueError(f"unknown inclusivity {inclusive!r}")
    x = F.col(t)
    return (x >= start if inclusive in ("left", "both") else x > start) & (x <= end if inclusive in ("right", "both") else x < end)


def align_to_baseline(df: DataFrame, value: str, t: str, start: float, end: float, by: Sequence[str] = (), inclusive: str = "left", also: Sequence[str] = ()) -> DataFrame:
    """Values less their mean over a window, and columns ``also`` less the same mean.

    A series with no value in the window raises an error.
    """
    base = F.avg(F.when(in_window(t, start, end, inclusive), F.col(value))).over(Window.partitionBy(*by))
    shifted = df.withColumn("_b", F.coalesce(base, F.raise_error(F.lit(f"no {value} between {start} and {end}")).cast("double")))
    return shifted.withColumns({c: F.col(c) - F.col("_b") for c in (value, *also)}).drop("_b")


def harmonize_baseline(df: DataFrame, value: str, t: str, window: tuple[int, int] = (1995, 2005), by: Sequence[str] = ()) -> DataFrame:
    """By calendar years, both included; the bounds and the smoothed series move along, errors do not."""
    also = [c for c in (f"{value}_lower", f"{value}_upper", f"{value}_smoothed") if c in df.columns]
    return align_to_baseline(df, value, t, window[0], window[1] + 1, by, "left", also)


def rebase_around(df: DataFrame, value: str, t: str, year: float, window: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """Less the mean within +-window of a year, or of +-(window + 5) if there is nothing."""
    w = Window.partitionBy(*by)
    near = F.avg(F.when(F.abs(F.col(t) - year) <= window, F.col(value))).over(w)
    wide = F.avg(F.when(F.abs(F.col(t) - year) <= window + 5, F.col(value))).over(w)
    return df.withColumn("_b", F.coalesce(near, wide)).withColumn(value, F.col(value) - F.col("_b")).drop("_b")


def resample_monthly(df: DataFrame, ts: str, value: str, sigma: str, resolution: int, by: Sequence[str] = ()) -> DataFrame:
    """A monthly series: values linear in time, errors of the nearest row, weights for the density.

    ``is_original``: a row of the input lies within 15 days; each new row weighs
    1 / resolution, and its error is larger by the root of the resolution.
    """
    day = micros("month") / 86_400e6
    grid = month_grid(df, ts, list(by)).withColumn("x", day)
    knots = df.withColumn("x", micros(ts) / 86_400e6).select(*by, "x", value, sigma)
    lines = interpolate(grid, knots.select(*by, "x", value), "x", [value], by)
    near = nearest(lines, knots.select(*by, "x", sigma), "x", [sigma], by)
    return near.select(*by, "month", value, (F.col(f"near_{sigma}") * F.sqrt(F.lit(float(resolution)))).alias(sigma), (F.abs(F.col("near_x") - F.col("x")) <= 15).alias("is_original"), F.lit(1.0 / resolution).alias("weight"))


def merged_resolutions(parts: Sequence[tuple[DataFrame, int]], columns: Sequence[str]) -> DataFrame:
    """UNION ALL of series with their resolution, weight and number; an empty list is an error."""
    if not parts:
        raise ValueError("nothing to merge")
    out = None
    for number, (df, months) in enumerate(parts):
        part = df.select(*columns).withColumns({"resolution": F.lit(months), "weight": F.lit(float(months)), "source": F.lit(number)})
        out = part if out is None else out.unionByName(part)
    return out


def dedup(df: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key: the first by ``order`` (give a priority descending for the last)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def history_and_scenario(history: DataFrame, scenario: DataFrame, t: str, split: float, by: Sequence[str], columns: Sequence[str], offset: float = 0.0) -> DataFrame:
    """History before ``split`` and the scenario; where both have a time the scenario's row stays."""
    both = history.filter(F.col(t) < split).select(*by, t, *columns).withColumn("_p", F.lit(0)).unionByName(scenario.select(*by, t, *columns).withColumn("_p", F.lit(1)))
    one = dedup(both, [*by, t], [F.desc("_p")]).drop("_p")
    return one.withColumns({c: F.col(c) - offset for c in columns})


def densified(df: DataFrame, t: str, values: Sequence[str], step: float, by: Sequence[str] = ()) -> DataFrame:
    """Linear values on a grid of ``step`` years from each series' first to its last row."""
    ends = df.groupBy(*by).agg(F.min(t).alias("_a"), F.max(t).alias("_z"))
    grid = ends.withColumn("_i", F.explode(F.sequence(F.lit(0), F.floor((F.col("_z") - F.col("_a")) / step + 1e-9).cast("int")))).select(*by, (F.col("_a") + F.col("_i") * step).alias(t))
    return interpolate(grid, df.select(*by, t, *values), t, values, by)


def spliced(model: DataFrame, observed: DataFrame, t: str, year: float, by: Sequence[str], value: str = "value") -> DataFrame:
    """Observations up to a year, then the model shifted to meet them there.

    ``observed`` has (t, value); the model has a row per ``by`` and t.
    """
    last = observed.filter(F.col(t) <= year).agg(F.max_by(value, t).alias("_o"))
    at = F.min_by(value, F.struct(F.abs(F.col(t) - year), F.col(t))).over(Window.partitionBy(*by))
    shifted = model.withColumn("_m", at).crossJoin(F.broadcast(last)).withColumn(value, F.col(value) - F.col("_m") + F.col("_o")).drop("_m", "_o")
    joined = shifted.join(observed.select(t, F.col(value).alias("_v")), t, "left")
    return joined.withColumn(value, F.when((F.col(t) <= year) & F.col("_v").isNotNull(), F.col("_v")).otherwise(F.col(value))).drop("_v")
