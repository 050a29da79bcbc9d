"""Local polynomial rates and accelerations: kernel-weighted least squares about every time.

Each centre's normal equations are fifteen sums over the points in reach; the 3 x 3 system is
solved in closed form, so the whole operator is a binned range join, one aggregation and
expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import kernel
from .align import within


def _det3(m: Sequence[Sequence[Column]]) -> Column:
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def kinematics(df: DataFrame, t: str, value: str, sigma: str, half_width: float, by: Sequence[str] = (), weight: str | None = None, least: float = 12.0, name: str = "tricube") -> DataFrame:
    """Level, rate and acceleration of a local quadratic at every time, with standard errors.

    Points weigh K((t - t0) / half_width) / sigma^2 times ``weight``; those below 1e-12 are
    left out. ``n_eff`` is the sum of ``weight`` (the count if there is none); centres with
    less than ``least`` are left out, as are singular ones. The scale of the errors is the
    weighted residual sum over n - 3. A sigma of zero or less is an error.
    """
    ok = F.when(F.col(sigma) > 0, F.col(sigma)).otherwise(F.raise_error(F.lit(f"{sigma} must be positive")).cast("double"))
    w = F.col(weight) if weight else F.lit(1.0)
    points = df.filter(F.col(value).isNotNull()).select(*by, F.col(t).alias("_t"), F.col(value).alias("_y"), (w / (ok * ok)).alias("_w"), w.alias("_e"))
    centres = df.filter(F.col(value).isNotNull()).select(*by, F.col(t).alias("centre")).distinct()
    reach = half_width if name != "gaussian" else 7.5 * half_width
    near = within(centres, points, "_t", reach, by, bins=half_width)
    d = F.col("_t") - F.col("centre")
    near = near.withColumn("_d", d).withColumn("_k", kernel(d / half_width, name) * F.col("_w")).filter("_k > 1e-12")
    k, x, y = F.col("_k"), F.col("_d"), F.col("_y")
    sums = {f"s{p}": F.sum(k * F.pow(x, p)) for p in range(5)} | {f"y{p}": F.sum(k * y * F.pow(x, p)) for p in range(3)}
    g = near.groupBy(*by, "centre").agg(*[v.alias(n) for n, v in sums.items()], F.sum(k * y * y).alias("yy"), F.sum("_e").alias("n_eff"), F.count(F.lit(1)).alias("n"))
    s = [F.col(f"s{p}") for p in range(5)]
    b = [F.col("y0"), F.col("y1"), F.col("y2") / 2]
    m = [[s[0], s[1], s[2] / 2], [s[1], s[2], s[3] / 2], [s[2] / 2, s[3] / 2, s[4] / 4]]
    g = g.withColumn("_det", _det3(m))
    for i, out in enumerate(("level", "rate", "accel")):
        g = g.withColumn(out, _det3([[b[r] if c == i else m[r][c] for c in range(3)] for r in range(3)]) / F.col("_det"))
    left = F.greatest(F.col("yy") - (F.col("level") * b[0] + F.col("rate") * b[1] + F.col("accel") * b[2]), F.lit(0.0)) / (F.col("n") - 3)
    minors = {"level_se": m[1][1] * m[2][2] - m[1][2] * m[1][2], "rate_se": m[0][0] * m[2][2] - m[0][2] * m[0][2], "accel_se": m[0][0] * m[1][1] - m[0][1] * m[0][1]}
    for out, minor in minors.items():
        g = g.withColumn(out, F.sqrt(F.greatest(minor / F.col("_det"), F.lit(0.0)) * left))
    return g.filter((F.col("n_eff") >= least) & (F.col("n") > 3) & (F.col("_det") > 0)).select(*by, "centre", "level", "rate", "accel", "level_se", "rate_se", "accel_se", "n_eff", "n")


def kinematics_bandwidths(df: DataFrame, t: str, value: str, sigma: str, half_widths: Sequence[float], by: Sequence[str] = (), **options) -> DataFrame:
    """The same for several half-widths (column ``half_width``)."""
    out = None
    for h in half_widths:
        part = kinematics(df, t, value, sigma, h, by, **options).withColumn("half_width", F.lit(float(h)))
        out = part if out is None else out.unionByName(part)
    return out


def one_per_year(kin: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of each year the centre nearest to its middle, the earlier of two."""
    year = F.floor("centre").cast("int")
    near = F.struct(F.abs(F.col("centre") - (year + 0.5)), F.col("centre"))
    return kin.withColumn("year", year).groupBy(*by, "year").agg(*[F.min_by(c, near).alias(c) for c in ("centre", "rate", "rate_se", "accel", "accel_se", "n_eff")])


def correlation_of_rates(centres: DataFrame, half_width: float, step: float = 1 / 12, name: str = "tricube", nugget: float = 0.0) -> DataFrame:
    """Correlation of the errors of local rates: overlap of their kernel weight vectors on a regular grid.

    Rows (a, b, rho); n_eff = n^2 / sum(rho).
    """
    ends = centres.agg(F.min("centre").alias("lo"), F.max("centre").alias("hi"))
    grid = ends.select(F.explode(F.sequence(F.lit(0), F.ceil((F.col("hi") - F.col("lo") + 2 * half_width) / step).cast("int"))).alias("i"), "lo").select((F.col("lo") - half_width + F.col("i") * step).alias("_t"))
    w = within(centres.select("centre"), grid, "_t", half_width).withColumn("w", (F.col("_t") - F.col("centre")) * kernel((F.col("_t") - F.col("centre")) / half_width, name))
    norm = w.groupBy("centre").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    w = w.join(norm, "centre").select("_t", "centre", (F.col("w") / F.col("norm")).alias("w"))
    pairs = w.select("_t", F.col("centre").alias("a"), F.col("w").alias("wa")).join(w.select("_t", F.col("centre").alias("b"), F.col("w").alias("wb")), "_t")
    rho = pairs.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("rho"))
    return rho.withColumn("rho", F.when(F.col("a") == F.col("b"), F.col("rho") + nugget).otherwise(F.col("rho")))
