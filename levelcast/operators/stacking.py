"""Stacking of predictive densities: models are judged on what came after each of some end times, and mixed by the weights that would have foretold it best.

Scores are rows, one per fold (end time), held-out time and model. The weights of a series maximise the mean logarithm of the mixture's density; the simplex optimiser is the EM
step w <- mean of w p / (sum of w p), which never leaves the simplex and never lowers the score. A fold's influence is how far the weights move without it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .regress import _fields, _grouped


def fold_scores(df: DataFrame, y: str, t: str, by: Sequence[str], ends: DataFrame, degrees: Mapping[str, int], horizon: float = 10.0, least: int = 8) -> DataFrame:
    """(by..., end, model, t, log_density): polynomials of the named degrees fitted up to each ``end``, with the density of each row of the horizon after it.

    Folds with fewer than ``least`` rows before, or none after, are left out; so are rows with a null.
    """
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(d).alias("_d")) for m, d in degrees.items()]))
    grid = df.select(*by, t, y).dropna(subset=[t, y]).crossJoin(F.broadcast(ends)).filter(F.col(t) <= F.col("end") + horizon)
    grid = grid.withColumn("_m", models).select(*by, "end", F.col("_m.model").alias("model"), F.col("_m._d").alias("_d"), F.col("end").alias("_end"), F.col(t).alias("_t"), F.col(y).alias("_y"))

    def fit(pdf: pd.DataFrame) -> dict:
        end, degree = float(pdf["_end"].iloc[0]), int(pdf["_d"].iloc[0])
        past, future = pdf[pdf["_t"] <= end], pdf[pdf["_t"] > end].sort_values("_t")
        if len(past) < max(least, degree + 2) or not len(future):
            return {"t": [], "log_density": []}
        x = lambda d: np.vander(d["_t"].to_numpy(float) - end, degree + 1)
        f = stats.Fit(x(past), past["_y"].to_numpy(float))
        var = np.maximum(f.scale, 1e-300) * (1 + np.einsum("ij,jk,ik->i", x(future), np.linalg.pinv(x(past).T @ x(past)), x(future)))
        r = future["_y"].to_numpy(float) - x(future) @ f.coef
        return {"t": future["_t"].to_numpy(float), "log_density": -0.5 * (np.log(2 * np.pi * var) + r**2 / var)}

    return _grouped(grid, [*by, "end", "model"], ["_d", "_end", "_t", "_y"], fit, "t double, log_density double")


def em_weights(log_density: np.ndarray, rounds: int = 20_000, close: float = 1e-12) -> np.ndarray:
    """Weights of the columns of a table of log-densities (points by models)."""
    p = np.exp(log_density - log_density.max(axis=1, keepdims=True))
    w = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        new = (w * p / (p @ w)[:, None]).mean(axis=0)
        if np.abs(new - w).max() < close:
            return new
        w = new
    return w


def stacked(scores: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(weights, influence): (by..., model, weight, mean_log_density, n) of each series, and (by..., end, model, weight, moved) without each fold.

    Points that not every model has are left out. ``moved`` is half the sum of the weights' absolute changes, the same for all models of a fold.
    A series' points are held by one task.
    """
    by = list(by)

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.pivot_table(index=["end", "t"], columns="model", values="log_density").dropna().sort_index()

    def weights(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = table(pdf)
        if not len(wide):
            return pd.DataFrame(columns=[*by, "model", "weight", "mean_log_density", "n"])
        out = pd.DataFrame({"model": wide.columns, "weight": em_weights(wide.to_numpy()), "mean_log_density": wide.mean().to_numpy(), "n": len(wide)})
        for k, v in zip(by[::-1], key[::-1], strict=True):
            out.insert(0, k, v)
        return out

    def influence(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide, rows = table(pdf), []
        ends = wide.index.get_level_values("end")
        if len(set(ends)) > 1:
            base = em_weights(wide.to_numpy())
            for end in sorted(set(ends)):
                own = em_weights(wide[ends != end].to_numpy())
                rows += [(*key, end, m, w, np.abs(own - base).sum() / 2) for m, w in zip(wide.columns, own, strict=True)]
        return pd.DataFrame(rows, columns=[*by, "end", "model", "weight", "moved"])

    kinds = _fields(scores, by)
    grouped = scores.select(*by, "end", "model", "t", "log_density").groupBy(*by)
    return grouped.applyInPandas(weights, kinds + "model string, weight double, mean_log_density double, n long"), grouped.applyInPandas(influence, kinds + "end double, model string, weight double, moved double")
