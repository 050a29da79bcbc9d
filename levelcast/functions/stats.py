"""Distribution functions and least squares in numpy (for use on the driver and inside grouped functions)."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(48)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _bisect(f: Callable[[float], float], low: float, high: float) -> float:
    for _ in range(60):
        mid = (low + high) / 2
        if f(mid) < 0:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def skew_normal_cdf(x: float, alpha: float) -> float:
    """Phi(x) - 2 T(x, alpha), Owen's T by Gauss-Legendre quadrature."""
    t = alpha * (_NODES + 1) / 2
    owen = alpha / 2 * float(_WEIGHTS @ (np.exp(-0.5 * x * x * (1 + t * t)) / (1 + t * t))) / (2 * math.pi)
    return NormalDist().cdf(x) - 2 * owen


def skew_normal_quantile(p: float, alpha: float) -> float:
    return normal_quantile(p) if alpha == 0 else _bisect(lambda x: skew_normal_cdf(x, alpha) - p, -12, 12)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def t_cdf(t: float, df: float) -> float:
    tail = beta_cdf(df / (df + t * t), df / 2, 0.5) / 2
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    return _bisect(lambda x: t_cdf(x, df) - p, -1e3, 1e3)


def t_p_value(t: float, df: float) -> float:
    """Two-sided."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_p_value(f: float, df1: float, df2: float) -> float:
    """Upper tail."""
    return 1.0 if f <= 0 else beta_cdf(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)


class Fit:
    """Weighted least squares with plain or autocorrelation-robust (Bartlett kernel) covariance."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, lags: int | None = None) -> None:
        w = np.ones(len(y)) if weights is None else np.asarray(weights, float)
        root = np.sqrt(w)
        xw, yw = x * root[:, None], y * root
        self.n, self.k = x.shape
        bread = np.linalg.pinv(xw.T @ xw)
        self.coef = bread @ (xw.T @ yw)
        self.fitted = x @ self.coef
        self.resid = y - self.fitted
        rw = self.resid * root
        self.ssr = float(rw @ rw)
        self.scale = self.ssr / max(1, self.n - self.k)
        if lags is None:
            self.cov = bread * self.scale
        else:
            score = xw * rw[:, None]
            meat = score.T @ score
            for lag in range(1, min(lags, self.n - 1) + 1):
                g = score[lag:].T @ score[:-lag]
                meat += (1 - lag / (lags + 1)) * (g + g.T)
            self.cov = bread @ meat @ bread
        self.se = np.sqrt(np.clip(np.diag(self.cov), 0, None))
        centre = float((w * y).sum() / w.sum())
        total = float((w * (y - centre) ** 2).sum())
        self.r2 = 1 - self.ssr / total if total > 0 else math.nan
        self.loglik = -self.n / 2 * (math.log(2 * math.pi * max(self.ssr, 1e-300) / self.n) + 1) + 0.5 * float(np.log(w).sum())
        self.aic, self.bic = 2 * self.k - 2 * self.loglik, self.k * math.log(self.n) - 2 * self.loglik


def hac_lags(n: float) -> int:
    """Newey-West rule: floor(4 (n/100)^(2/9))."""
    return int(math.floor(4 * (n / 100) ** (2 / 9)))


def ar1(resid: np.ndarray) -> float:
    """Lag-one autocorrelation, kept inside (-1, 1)."""
    r = resid - resid.mean()
    d = float(r @ r)
    return float(np.clip((r[1:] @ r[:-1]) / d if d > 0 else 0.0, -0.99, 0.99))
