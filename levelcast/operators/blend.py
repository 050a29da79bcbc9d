"""Blending of rates of a near-term extrapolation and of component samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fading_weight
from .sequence import cumulative_trapezoid, gradient


def blend_rates(components: DataFrame, extrapolated: DataFrame, value: str, t: str, by: Sequence[str], origin: float, level: float, centre: float, tau: float) -> DataFrame:
    """Levels whose rate is the weighted mean of an extrapolated rate and each sample's own.

    ``extrapolated`` has (by..., t, rate); the weight falls from 1 to 0 about ``centre``; from
    ``origin`` on the rate is integrated by trapezoid from ``level``.
    """
    own = gradient(components, value, t, "_own", by)
    joined = own.join(extrapolated.withColumnRenamed("rate", "_ext"), [*by, t])
    w = fading_weight(t, centre, tau)
    mixed = joined.withColumn("rate", w * F.col("_ext") + (1 - w) * F.col("_own")).filter(F.col(t) >= origin)
    out = cumulative_trapezoid(mixed, "rate", t, "blended", by)
    return out.withColumn("blended", F.col("blended") + level).select(*by, t, "rate", "blended")


def blend_hindcast(components: DataFrame, extrapolated: DataFrame, value: str, t: str, by: Sequence[str], centre: float, tau: float, baseline: float) -> DataFrame:
    """The same for the past: the components' weight falls with time; levels are zero at ``baseline``."""
    own = gradient(components, value, t, "_own", by)
    joined = own.join(extrapolated.withColumnRenamed("rate", "_ext"), [*by, t])
    w = fading_weight(t, centre, tau)
    mixed = joined.withColumn("rate", w * F.col("_own") + (1 - w) * F.col("_ext"))
    out = cumulative_trapezoid(mixed, "rate", t, "blended", by)
    base = F.min_by("blended", F.struct(F.abs(F.col(t) - baseline), F.col(t))).over(Window.partitionBy(*by))
    return out.withColumn("blended", F.col("blended") - base).select(*by, t, "rate", "blended")
