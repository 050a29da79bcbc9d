"""Draws of skew-normal distributions whose parameters differ from row to row, by inverting their distribution function in expressions.

The function is Phi(x) - 2 T(x, alpha); both parts are integrals over [0, 1] with the same Gauss-Legendre nodes. A cell's values on a grid are made once; a draw finds its
bracket there and is refined by Newton steps that never leave it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from .paths import dealt

#: Nodes of the quadrature, ends and number of the grid's steps, Newton steps.
NODES, EDGE, STEPS, NEWTON = 48, 10.0, 160, 4


def distribution(x: Column, alpha: Column) -> Column:
    """Distribution function of the standard skew-normal, for shapes within about 30."""
    at, weight = np.polynomial.legendre.leggauss(NODES)
    nodes = F.array(*[F.struct(F.lit(float((a + 1) / 2) ** 2).alias("s"), F.lit(float(w / 2)).alias("w")) for a, w in zip(at, weight, strict=True)])

    def add(acc: Column, node: Column) -> Column:
        plain = F.exp(-x * x * node["s"] / 2)
        flat = 1 + alpha * alpha * node["s"]
        return acc + node["w"] * (x / math.sqrt(2 * math.pi) * plain - alpha / math.pi * F.exp(-x * x * flat / 2) / flat)

    return F.aggregate(nodes, F.lit(0.5), add)


def _normal_part(x: Column) -> Column:
    at, weight = np.polynomial.legendre.leggauss(NODES)
    nodes = F.array(*[F.struct(F.lit(float((a + 1) / 2) ** 2).alias("s"), F.lit(float(w / 2)).alias("w")) for a, w in zip(at, weight, strict=True)])
    small = F.least(F.greatest(x, F.lit(-EDGE)), F.lit(EDGE))
    return F.aggregate(nodes, F.lit(0.5), lambda acc, node: acc + node["w"] * small / math.sqrt(2 * math.pi) * F.exp(-small * small * node["s"] / 2))


def with_grid(cells: DataFrame, alpha: str = "alpha", grid: str = "grid") -> DataFrame:
    """Cells with their distribution function at the grid's steps."""
    steps = F.sequence(F.lit(0), F.lit(STEPS))
    return cells.withColumn(grid, F.transform(steps, lambda i: distribution(i * (2 * EDGE / STEPS) - EDGE, F.col(alpha))))


def inverse(rows: DataFrame, u: str, out: str, alpha: str = "alpha", grid: str = "grid") -> DataFrame:
    """Rows with the standard quantile of ``u`` (between 0 and 1) as column ``out``; they have the cell's shape and grid."""
    width, shape = 2 * EDGE / STEPS, F.col(alpha)
    below = F.size(F.filter(F.col(grid), lambda c: c < F.col(u)))
    low = F.least(F.greatest(below - 1, F.lit(0)), F.lit(STEPS - 1)) * width - EDGE

    def newton(lo: Column, x: Column) -> Column:
        density = F.sqrt(F.lit(2 / math.pi)) * F.exp(-x * x / 2) * _normal_part(shape * x)
        return F.least(F.greatest(x - F.coalesce((distribution(x, shape) - F.col(u)) / F.nullif(density, F.lit(0.0)), F.lit(0.0)), lo), lo + width)

    # bound as variables of functions, so that no step's expression is copied into the next
    steps = F.sequence(F.lit(1), F.lit(NEWTON))
    refined = F.transform(F.array(low), lambda lo: F.aggregate(steps, lo + width / 2, lambda x, _: newton(lo, x)))
    return rows.withColumn(out, F.get(refined, F.lit(0)))


def sampled(fits: DataFrame, ids: DataFrame, by: Sequence[str], stream: str = "skewed") -> DataFrame:
    """(by..., sample_id, value): a draw of every sample in every cell of fitted ``loc``, ``scale`` and ``alpha``.

    Uniforms are hashes of the cell and the sample, so that draws repeat under any partitioning. Cells are few (one for a component, scenario and year).
    """
    cells = with_grid(fits.select(*by, "loc", "scale", "alpha"))
    rows = dealt(ids).crossJoin(F.broadcast(cells)).withColumn("_u", draws.uniform(stream, *[F.col(c).cast("string") for c in by], F.col("sample_id").cast("string")))
    out = inverse(rows, "_u", "_z")
    return out.select(*by, "sample_id", (F.col("loc") + F.col("scale") * F.col("_z")).alias("value"))
