"""Dynamic regressions about every time, from sums that merge.

A centre's weighted normal equations are sums over its rows, and so is the autocorrelation-robust covariance, once residuals are known: with scores s (weight
times regressors times residual) and their Bartlett-weighted lags v, it is the sum of s s' + s v' + v s'. Both are made in expressions and combined before the shuffle; what is
solved outside the JVM is one small system per centre, many at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import kernel
from .align import within
from .regress import dynamic_design


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _square(flat: np.ndarray, p: int) -> np.ndarray:
    """Symmetric matrices of their upper triangles."""
    out = np.zeros((len(flat), p, p))
    for k, (i, j) in enumerate(_pairs(p)):
        out[:, i, j] = out[:, j, i] = flat[:, k]
    return out


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.array(batch.column(column).to_pylist(), float)


def sliding_dynamic(
    df: DataFrame, level: str, temp: str, t: str, by: Sequence[str], half_width: float = 40.0, order: int = 2, n_lags: int = 2, least: float = 30.0, name: str = "tricube",
    sigma: str | None = None, saod: str | None = None,
) -> DataFrame:
    """Dynamic least squares with kernel weights (times 1 / sigma^2) about every time; the design, with a second forcing ``saod`` if given, is made once.

    Rows (by..., centre, term, coef, se, n, r2, aic, bic, scale, n_eff). ``n_eff`` is Kish's (sum w)^2 / sum w^2; the HAC lags follow it; centres with less
    than ``least``, or no more rows than terms, are left out. Rows with a null are left out.
    """
    by = list(by)
    design, names = dynamic_design(df, temp, t, order, n_lags, saod, by)
    used = [level, *names, *([sigma] if sigma else [])]
    design = design.dropna(subset=used)
    p = len(names) + 1
    # regressors and level less their means in the series, so that the sums stay small
    whole = Window.partitionBy(*by)
    xs = [f"_x{i}" for i in range(p)]
    points = design.select(
        *by, t, (F.col(level) - F.avg(level).over(whole)).alias("_y"), *[(F.col(c) - F.avg(c).over(whole)).alias(x) for c, x in zip(names, xs, strict=False)], F.lit(1.0).alias(xs[-1]),
        F.array(*[F.avg(c).over(whole) for c in [*names, level]]).alias("_means"), (1 / (F.col(sigma) * F.col(sigma)) if sigma else F.lit(1.0)).alias("_w0"),
    )
    near = within(design.select(*by, F.col(t).alias("centre")), points, t, half_width, by)
    near = near.withColumn("_w", F.col("_w0") * kernel((F.col(t) - F.col("centre")) / half_width, name)).filter("_w > 1e-12")
    w, y = F.col("_w"), F.col("_y")
    keys = [*by, "centre"]
    sums = near.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), F.sum(w * y).alias("sy"), F.sum(w * y * y).alias("syy"), F.sum(F.log(w)).alias("slog"), F.first("_means").alias("means"),
        F.array(*[F.sum(w * F.col(xs[i]) * F.col(xs[j])) for i, j in _pairs(p)]).alias("a"), F.array(*[F.sum(w * F.col(x) * y) for x in xs]).alias("b"),
    )
    sums = sums.withColumn("n_eff", F.col("sw") * F.col("sw") / F.col("sw2")).filter((F.col("n_eff") >= least) & (F.col("n") > p))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a = _square(_matrix(batch, "a"), p)
                # of unit diagonal, so that regressors of different sizes do not cost digits
                size = np.sqrt(np.maximum(np.einsum("mii->mi", a), 1e-300))
                scale = size[:, :, None] * size[:, None, :]
                bread = np.linalg.pinv(a / scale, hermitian=True) / scale
                coef = np.einsum("mij,mj->mi", bread, _matrix(batch, "b"))
                more = [pa.array(coef.tolist(), pa.list_(pa.float64())), pa.array(bread.reshape(len(bread), -1).tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "coef", "bread"])

    fields = lambda d: d.schema.simpleString()[7:-1]
    solved = sums.mapInArrow(solve, fields(sums) + ",coef:array<double>,bread:array<double>")
    lags = F.floor(4 * F.pow(F.col("n_eff") / 100, 2 / 9))
    solved = solved.withColumn("lags", F.least(lags, F.col("n") - 1).cast("int")).withColumn("span", (lags + 1).cast("double"))
    scored = near.select(*keys, t, "_y", "_w", *xs).join(solved.select(*keys, F.col("coef").alias("_c"), "lags", "span"), keys)
    scored = scored.withColumn("_r", F.col("_y") - sum((F.get("_c", F.lit(i)) * F.col(x) for i, x in enumerate(xs)), F.lit(0.0)))
    scored = scored.withColumns({f"_s{i}": w * F.col(x) * F.col("_r") for i, x in enumerate(xs)})
    # the number of rows of a centre bounds its lags
    most = int(np.floor(4 * (max(1, near.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1) / 100) ** (2 / 9)))
    path = Window.partitionBy(*keys).orderBy(t)
    late = lambda i: sum((F.when(F.col("lags") >= k, 1 - k / F.col("span")).otherwise(0.0) * F.coalesce(F.lag(f"_s{i}", k).over(path), F.lit(0.0)) for k in range(1, most + 1)), F.lit(0.0))
    scored = scored.withColumns({f"_v{i}": late(i) for i in range(p)})
    meat = F.array(*[F.sum(F.col(f"_s{i}") * F.col(f"_s{j}") + F.col(f"_s{i}") * F.col(f"_v{j}") + F.col(f"_v{i}") * F.col(f"_s{j}")) for i, j in _pairs(p)])
    meats = scored.groupBy(*keys).agg(meat.alias("meat"), F.sum(w * F.col("_r") * F.col("_r")).alias("ssr"))
    both = solved.join(meats, keys).drop("a", "b", "lags", "span")
    terms = [*names, "const"]

    def robust(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.num_rows
            bread = _matrix(batch, "bread").reshape(m, p, p)
            cov = bread @ _square(_matrix(batch, "meat"), p) @ bread
            coef, means = _matrix(batch, "coef"), _matrix(batch, "means")
            # back from centred columns: only the constant differs
            turn = np.tile(np.eye(p), (m, 1, 1))
            turn[:, -1, :-1] = -means[:, :-1]
            se = np.sqrt(np.clip(np.einsum("mij,mjk,mik->mi", turn, cov, turn), 0, None))
            coef = np.einsum("mij,mj->mi", turn, coef)
            coef[:, -1] += means[:, -1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(coef.tolist(), pa.list_(pa.float64())), pa.array(se.tolist(), pa.list_(pa.float64()))], names=[*batch.schema.names, "coefs", "ses"])

    out = both.mapInArrow(robust, fields(both) + ",coefs:array<double>,ses:array<double>")
    n = F.col("n")
    loglik = -n / 2 * (F.log(2 * np.pi * F.greatest("ssr", F.lit(1e-300)) / n) + 1) + 0.5 * F.col("slog")
    total = F.col("syy") - F.col("sy") * F.col("sy") / F.col("sw")
    out = out.withColumns({"aic": 2 * p - 2 * loglik, "bic": p * F.log(n) - 2 * loglik, "r2": F.when(total > 0, 1 - F.col("ssr") / total), "scale": F.col("ssr") / (n - p)})
    named = F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in terms]).alias("term"), F.col("coefs").alias("coef"), F.col("ses").alias("se")))
    return out.select(*keys, "n", "r2", "aic", "bic", "scale", "n_eff", named.alias("z")).select(*keys, "z.term", "z.coef", "z.se", "n", "r2", "aic", "bic", "scale", "n_eff")
