"""Bayesian calibrations: log-densities in numpy, ensemble samplers, Kalman filters, diagnostics.

A calibration is one series; there are many series, scenarios and data sets. Every series has several independent
chains; a task moves one chain of some dozens of series at once, as numpy arrays with an axis for them, and returns the moments of
blocks of the chain and thinned draws. R-hat and effective sizes are merged from those moments in Spark.
Samplers are the affine-invariant stretch move (Goodman and Weare, 2010) and the
differential-evolution move (ter Braak and Vrugt, 2008); every chain is seeded by its series.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder
from . import sequence
from .regress import _fields

LogDensity = Callable[[np.ndarray], float]


def sample(log_density: LogDensity, start: np.ndarray, spread: np.ndarray, walkers: int = 32, burn: int = 500, keep: int = 1000, thin: int = 2, seed: int = 0, moves: str = "stretch") -> np.ndarray:
    """Chains of shape (kept steps, walkers, parameters), half the ensemble moved against the other half."""
    rng = np.random.default_rng(seed)
    dim = len(start)
    walkers = max(walkers, 2 * dim + 2) // 2 * 2
    x = start + spread * rng.normal(size=(walkers, dim))
    lp = np.array([log_density(p) for p in x])
    for _ in range(200):
        bad = ~np.isfinite(lp)
        if not bad.any():
            break
        x[bad] = start + 0.3 * spread * rng.normal(size=(int(bad.sum()), dim))
        lp[bad] = [log_density(p) for p in x[bad]]
    out = []
    half = walkers // 2
    for step in range(burn + keep):
        for first in (True, False):
            own = np.arange(half) if first else np.arange(half, walkers)
            other = np.arange(half, walkers) if first else np.arange(half)
            if moves == "mixed" and rng.random() < 0.2:
                a, b = rng.choice(other, half), rng.choice(other, half)
                gain = 2.38 / math.sqrt(2 * dim) if rng.random() > 0.1 else 1.0
                new = x[own] + gain * (x[a] - x[b]) + 1e-5 * spread * rng.normal(size=(half, dim))
                factor = np.zeros(half)
            else:
                z = (1 + rng.random(half)) ** 2 / 2
                new = x[rng.choice(other, half)] * (1 - z[:, None]) + z[:, None] * x[own]
                factor = (dim - 1) * np.log(z)
            lp_new = np.array([log_density(p) for p in new])
            take = np.log(rng.random(half)) < lp_new - lp[own] + factor
            x[own[take]], lp[own[take]] = new[take], lp_new[take]
        if step >= burn and (step - burn) % thin == 0:
            out.append(x.copy())
    return np.array(out)


def r_hat(chains: np.ndarray) -> np.ndarray:
    """Split R-hat of each parameter."""
    n = chains.shape[0] // 2
    s = np.concatenate([chains[:n], chains[n : 2 * n]], axis=1)
    within = s.var(axis=0, ddof=1).mean(axis=0)
    between = n * s.mean(axis=0).var(axis=0, ddof=1)
    return np.sqrt(((n - 1) / n * within + between / n) / np.maximum(within, 1e-300))


def effective_size(chains: np.ndarray) -> np.ndarray:
    """Bulk effective sample size by the initial positive sequence of mean autocorrelations."""
    n, m, dim = chains.shape
    out = np.empty(dim)
    for k in range(dim):
        x = chains[:, :, k] - chains[:, :, k].mean(axis=0)
        size = 1 << (2 * n - 1).bit_length()
        f = np.fft.rfft(x, size, axis=0)
        acf = np.fft.irfft(f * f.conj(), size, axis=0)[:n].mean(axis=1)
        rho = acf / max(acf[0], 1e-300)
        pairs = rho[1:-1:2] + rho[2::2] if n > 3 else np.zeros(0)
        stop = np.argmax(pairs < 0) if (pairs < 0).any() else len(pairs)
        out[k] = n * m / max(1.0, 1 + 2 * (rho[1] * 0 + pairs[:stop].sum()))
    return out


def interval(x: np.ndarray, mass: float = 0.94) -> tuple[float, float]:
    """The shortest interval that holds a share of the draws."""
    s = np.sort(x)
    k = max(1, int(math.ceil(mass * len(s))))
    if k >= len(s):
        return float(s[0]), float(s[-1])
    i = int(np.argmin(s[k:] - s[: len(s) - k]))
    return float(s[i]), float(s[i + k])


def exponential_scale(probability: float = 0.1, threshold: float = 0.005) -> float:
    """Scale of an exponential prior that exceeds ``threshold`` with the given probability."""
    if not 0 < probability < 1 or threshold <= 0:
        raise ValueError("need 0 < probability < 1 and threshold > 0")
    return -threshold / math.log(probability)


# log-densities of priors, up to constants, of arrays or numbers


def _normal(x, s):
    return -0.5 * (x / s) ** 2


def _half_normal(x, s):
    return np.where(x >= 0, -0.5 * (x / s) ** 2, -np.inf)


def _half_cauchy(x, s):
    return np.where(x >= 0, -np.log1p((x / s) ** 2), -np.inf)


def _exponential(x, s):
    return np.where(x >= 0, -x / s, -np.inf)


def _gauss(resid: np.ndarray, var: np.ndarray) -> float:
    return -0.5 * float((resid**2 / var + np.log(var)).sum())


def relax(t: np.ndarray, f: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """States of dS/dt = (f - S) / tau along the last axis, stepped exactly; f itself below a hundredth of a year, constant above a million.

    ``tau`` has the other axes of the result.
    """
    tau = np.asarray(tau, float)
    shape = (*np.broadcast_shapes(t.shape[:-1], f.shape[:-1], tau.shape), f.shape[-1])
    f = np.broadcast_to(f, shape)
    out = np.empty(shape)
    out[..., 0] = f[..., 0]
    decay = np.exp(-np.diff(t) / np.maximum(tau, 0.01)[..., None])
    decay = np.broadcast_to(np.where(tau[..., None] >= 1e6, 1.0, decay), (*shape[:-1], shape[-1] - 1))
    mean = (f[..., 1:] + f[..., :-1]) / 2
    add = mean * (1 - decay)
    for i in range(1, shape[-1]):
        out[..., i] = add[..., i - 1] + out[..., i - 1] * decay[..., i - 1]
    return np.where(tau[..., None] < 0.01, f, out)


def integral(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Trapezoid along the last axis, 0 at its first place."""
    steps = np.cumsum(0.5 * (x[..., 1:] + x[..., :-1]) * np.diff(t), axis=-1)
    return np.concatenate([np.zeros_like(steps[..., :1]), steps], axis=-1)


class Batch:
    """Columns of some series as arrays (series, 1, rows), the shorter ones filled up with their last row; ``known`` tells a series' own rows."""

    def __init__(self, series: Sequence[pd.DataFrame]):
        self.sizes = np.array([len(p) for p in series])
        n = int(self.sizes.max())
        places = np.minimum(np.arange(n), self.sizes[:, None] - 1)
        self.known = (np.arange(n) < self.sizes[:, None])[:, None]
        self.columns = {c: np.stack([p[c].to_numpy(float)[at] for p, at in zip(series, places, strict=True)])[:, None] for c in series[0].columns}

    def __getitem__(self, column: str) -> np.ndarray:
        return self.columns[column]

    def own(self, i: int, *arrays: np.ndarray) -> list[np.ndarray]:
        """The rows of one series."""
        return [a[i, 0, : self.sizes[i]] for a in arrays]

    def mean(self, x: np.ndarray) -> np.ndarray:
        """Mean of each series, (series, 1)."""
        return np.where(self.known, x, 0).sum(axis=-1) / self.sizes[:, None]

    def gauss(self, resid: np.ndarray, var: np.ndarray) -> np.ndarray:
        """Normal log-density of residuals over the known rows, (series, walkers)."""
        return -0.5 * np.where(self.known, resid**2 / var + np.log(var), 0).sum(axis=-1)


@dataclass
class Model:
    """Parameter names, starting points and spreads (series, parameters), and the log-density of points (series, walkers, parameters)."""

    names: list[str]
    start: np.ndarray
    spread: np.ndarray
    log_density: Callable[[np.ndarray], np.ndarray]


def _terms(p: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Sum of parameters times columns, (series, walkers, rows)."""
    return sum(p[..., i, None] * c for i, c in enumerate(columns))


def level_model(d: Batch, order: int = 2, a_scale: float = 0.002171, b_scale: float = 0.01, c_scale: float = 0.005, symmetric: bool = False) -> Model:
    """H = a I2 + b I1 + c t + h0 with extra scatter: exponential (or normal) a, half-normal b, normal c, half-Cauchy scatter."""
    t, f, y, s = (d[c] for c in ("t", "temp", "level", "sigma"))
    i1, i2, i0 = integral(t, f), integral(t, f * f), t - t[..., :1]
    cols = [*([i2, i1, i0] if order == 2 else [i1, i0]), np.ones_like(t)]
    names = (["a"] if order == 2 else []) + ["b", "c", "h0", "extra"]
    start = []
    for i in range(len(t)):
        *x, own_y, own_s = d.own(i, *cols, y, s)
        fit = np.linalg.lstsq(np.column_stack(x) / own_s[:, None], own_y / own_s, rcond=None)[0]
        if not symmetric:
            fit[:order] = np.maximum(fit[:order], 1e-6)
        start.append([*fit, 0.5 * own_s.mean()])
    start, wide = np.array(start), d.mean(s)

    def density(p: np.ndarray) -> np.ndarray:
        prior = _half_cauchy(p[..., -1], wide) + _normal(p[..., -2], 1.0) + _normal(p[..., -3], c_scale)
        if order == 2:
            prior += _normal(p[..., 0], a_scale) if symmetric else _exponential(p[..., 0], a_scale)
        prior += _normal(p[..., order - 1], b_scale) if symmetric else _half_normal(p[..., order - 1], b_scale)
        return prior + d.gauss(y - _terms(p, *cols), s**2 + p[..., -1, None] ** 2)

    return Model(names, start, np.maximum(np.abs(start) * 0.1, 1e-5), density)


def normal_model(d: Batch, scales: Sequence[float] = (0.01, 0.005, 1.0)) -> Model:
    """H = b I1 + c t + h0 with normal priors and the given errors alone: the case whose posterior is known in closed form."""
    t, f, y, s = (d[c] for c in ("t", "temp", "level", "sigma"))
    cols = [integral(t, f), t - t[..., :1], np.ones_like(t)]
    start = np.column_stack([np.zeros(len(t)), np.zeros(len(t)), d.mean(y)[:, 0]])

    def density(p: np.ndarray) -> np.ndarray:
        return sum(_normal(p[..., i], k) for i, k in enumerate(scales)) + d.gauss(y - _terms(p, *cols), s**2)

    return Model(["b", "c", "h0"], start, np.full(start.shape, 0.005), density)


def state_model(d: Batch) -> Model:
    """The level model plus d times the integral of (S - T), S relaxing over tau (log-normal, 0.1 to 5000 years)."""
    base = level_model(d)
    t, f, y, s = (d[c] for c in ("t", "temp", "level", "sigma"))
    cols = [integral(t, f * f), integral(t, f), t - t[..., :1], np.ones_like(t)]
    wide = d.mean(s)

    def density(p: np.ndarray) -> np.ndarray:
        tau = np.exp(np.minimum(p[..., 5], 20))
        prior = _exponential(p[..., 0], 0.002171) + _half_normal(p[..., 1], 0.01) + _normal(p[..., 2], 0.005) + _normal(p[..., 3], 1)
        prior += _normal(p[..., 4], 0.005) + _normal(p[..., 5] - math.log(50), 1.0) + _half_cauchy(p[..., 6], wide)
        mean = _terms(p, *cols) + p[..., 4, None] * integral(t, relax(t, f, tau) - f)
        return np.where((tau >= 0.1) & (tau <= 5000), prior + d.gauss(y - mean, s**2 + p[..., -1, None] ** 2), -np.inf)

    one = np.ones((len(t), 1))
    start = np.hstack([base.start[:, :4], 0 * one, math.log(50) * one, base.start[:, -1:]])
    return Model(["a", "b", "c", "h0", "d", "log_tau", "extra"], start, np.hstack([base.spread[:, :4], 1e-3 * one, 0.3 * one, base.spread[:, -1:]]), density)


def thermosteric_model(d: Batch, layers: int = 1) -> Model:
    """H = a Su^2 + b Su (+ bd Sd) + c t + h0 with one or two relaxing layers."""
    t, f, y, s = (d[c] for c in ("t", "temp", "level", "sigma"))
    names = ["a", "b", "c", "h0", "log_tau"] + (["bd", "log_tau_d"] if layers == 2 else []) + ["extra"]
    wide = d.mean(s)

    def density(p: np.ndarray) -> np.ndarray:
        tau = np.exp(np.minimum(p[..., 4], 20))
        u = relax(t, f, tau)
        mean = _terms(p, u * u, u, t - t[..., :1], np.ones_like(t))
        prior = _normal(p[..., 0], 0.1) + _half_normal(p[..., 1], 0.5) + _normal(p[..., 2], 0.01) + _normal(p[..., 3], 1)
        prior += _normal(p[..., 4] - math.log(5), 1) + _half_cauchy(p[..., -1], wide)
        inside = (tau >= 0.05) & (tau <= 500)
        if layers == 2:
            tau_d = np.exp(np.minimum(p[..., 6], 20))
            inside &= (tau_d >= tau) & (tau_d <= 5000)
            mean = mean + p[..., 5, None] * relax(t, u, tau_d)
            prior += _half_normal(p[..., 5], 0.5) + _normal(p[..., 6] - math.log(150), 0.5)
        return np.where(inside, prior + d.gauss(y - mean, s**2 + p[..., -1, None] ** 2), -np.inf)

    fixed = [0.0, 0.05, 0.0, 0.0, math.log(5), *([0.05, math.log(150)] if layers == 2 else []), 0.0]
    start = np.tile(fixed, (len(t), 1))
    start[:, 3], start[:, -1] = y[:, 0, 0], 0.5 * wide[:, 0]
    return Model(names, start, np.maximum(np.abs(start) * 0.1, 1e-3), density)


def discharge_model(d: Batch) -> Model:
    """Discharge alone: g_atm I1 + g_ocean * integral of the lagged ocean state + d0 t + h0."""
    t, f, o, y, s = (d[c] for c in ("t", "temp", "ocean", "level", "sigma"))
    i1, wide = integral(t, f), d.mean(s)

    def density(p: np.ndarray) -> np.ndarray:
        mean = _terms(p, i1, integral(t, relax(t, o, np.exp(np.clip(p[..., 4], -1, 7)))), t - t[..., :1], np.ones_like(t))
        prior = _half_normal(p[..., 0], 0.01) + _half_normal(p[..., 1], 0.01) + _normal(p[..., 2], 0.01) + _normal(p[..., 3], 1)
        prior += _normal(p[..., 4] - math.log(10), 1) + _half_cauchy(p[..., 5], wide)
        return np.where((p[..., 4] >= -1) & (p[..., 4] <= 7), prior + d.gauss(y - mean, s**2 + p[..., 5, None] ** 2), -np.inf)

    start = np.tile([1e-3, 1e-3, 0.0, 0.0, math.log(10), 0.0], (len(t), 1))
    start[:, 3], start[:, 5] = y[:, 0, 0], 0.5 * wide[:, 0]
    spread = np.tile([5e-4, 5e-4, 1e-3, 0.01, 0.3, 0.0], (len(t), 1))
    spread[:, 5] = 0.2 * wide[:, 0]
    return Model(["g_atm", "g_ocean", "d0", "h0", "log_tau", "extra"], start, spread, density)


def joint_model(d: Batch) -> Model:
    """Surface balance a I2 + b I1 + h (column ``level2``) and discharge together, each with its own scatter."""
    base = discharge_model(d)
    t, f, y, s = (d[c] for c in ("t", "temp", "level2", "sigma2"))
    cols, wide = [integral(t, f * f), integral(t, f), np.ones_like(t)], d.mean(s)

    def density(p: np.ndarray) -> np.ndarray:
        own = p[..., 6:]
        prior = _exponential(own[..., 0], 0.002171) + _half_normal(own[..., 1], 0.01) + _normal(own[..., 2], 1) + _half_cauchy(own[..., 3], wide)
        return base.log_density(p[..., :6]) + prior + d.gauss(y - _terms(own, *cols), s**2 + own[..., 3, None] ** 2)

    more = np.tile([5e-4, 1e-3, 0.0, 0.0], (len(t), 1))
    more[:, 2], more[:, 3] = y[:, 0, 0], 0.5 * wide[:, 0]
    wider = np.tile([2e-4, 5e-4, 0.01, 0.0], (len(t), 1))
    wider[:, 3] = 0.2 * wide[:, 0]
    return Model([*base.names, "a", "b", "h0_smb", "extra_smb"], np.hstack([base.start, more]), np.hstack([base.spread, wider]), density)


def split_model(d: Batch) -> Model:
    """One level as immediate and lagged response: total sensitivity b, of which a share f (Beta 2, 2) acts through a state of time tau."""
    t, f, y, s = (d[c] for c in ("t", "temp", "level", "sigma"))
    i1, wide = integral(t, f), d.mean(s)

    def density(p: np.ndarray) -> np.ndarray:
        b, share, c, h0, log_tau, extra = np.moveaxis(p, -1, 0)
        inside = (share > 0) & (share < 1) & (log_tau >= -1) & (log_tau <= 7)
        inner = np.clip(share, 1e-12, 1 - 1e-12)
        late = integral(t, relax(t, f, np.exp(np.clip(log_tau, -1, 7))))
        mean = b[..., None] * ((1 - share[..., None]) * i1 + share[..., None] * late) + c[..., None] * (t - t[..., :1]) + h0[..., None]
        prior = np.log(inner * (1 - inner)) + _half_normal(b, 0.01) + _normal(c, 0.005) + _normal(h0, 1) + _normal(log_tau - math.log(30), 1) + _half_cauchy(extra, wide)
        return np.where(inside, prior + d.gauss(y - mean, s**2 + extra[..., None] ** 2), -np.inf)

    start = np.tile([2e-3, 0.5, 0.0, 0.0, math.log(30), 0.0], (len(t), 1))
    start[:, 3], start[:, 5] = y[:, 0, 0], 0.5 * wide[:, 0]
    spread = np.tile([1e-3, 0.1, 1e-3, 0.01, 0.3, 0.0], (len(t), 1))
    spread[:, 5] = 0.2 * wide[:, 0]
    return Model(["b", "share", "c", "h0", "log_tau", "extra"], start, spread, density)


def rate_model(d: Batch, span: float = 15.0) -> Model:
    """Rates a T^2 + b T + c with errors correlated over the kernel that made them; coefficients are not negative.

    The extra scatter is the same in all directions, so the errors' covariance is brought to its axes once for all points.
    """
    t, f, y, s = (d[c] for c in ("t", "temp", "level", "sigma"))
    n = t.shape[-1]
    values, vectors = np.ones((len(t), 1, n)), np.tile(np.eye(n), (len(t), 1, 1))
    for i, k in enumerate(d.sizes):
        own_t, own_s = d.own(i, t, s)
        u = np.abs(own_t[:, None] - own_t[None, :]) / (2 * span)
        corr = np.where(u < 1, (1 - u) ** 2 * (1 + u / 2), 0.0) + 1e-6 * np.eye(k)
        w, v = np.linalg.eigh(corr * np.outer(own_s, own_s))
        values[i, 0, :k], vectors[i, :k, :k] = np.maximum(w, 1e-6 * w.max()), v
    wide = d.mean(s)

    def density(p: np.ndarray) -> np.ndarray:
        resid = np.where(d.known, y - _terms(p, f * f, f, np.ones_like(t)), 0) @ vectors
        prior = _half_normal(p[..., 0], 0.01) + _half_normal(p[..., 1], 0.01) + _half_normal(p[..., 2], 0.01) + _half_cauchy(p[..., 3], wide)
        return prior + d.gauss(resid, values + p[..., 3, None] ** 2)

    start = np.column_stack([np.full(len(t), 1e-3), np.full(len(t), 1e-3), np.maximum(d.mean(y)[:, 0], 1e-4), 0.5 * wide[:, 0]])
    return Model(["a", "b", "c", "extra"], start, np.maximum(start * 0.2, 1e-5), density)


def linear_model(d: Batch, y: str, names: Sequence[str], physical: int, sigma: str | None = None) -> Model:
    """A static regression on a scaled design: wide priors on the physical terms, unit priors on leads and lags."""
    cols, start, spread, scatter = [], [], [], []
    for c in names:
        centre = d.mean(d[c])[..., None]
        scale = np.sqrt(d.mean((d[c] - centre) ** 2))[..., None]
        cols.append((d[c] - centre) / np.where(scale == 0, 1, scale))
    cols.append(np.ones_like(d[y]))
    for i in range(len(d.sizes)):
        *x, own = d.own(i, *cols, d[y])
        x = np.column_stack(x)
        ols = np.linalg.lstsq(x, own, rcond=None)[0]
        resid = float((own - x @ ols).std()) or 1e-6
        scatter.append(resid)
        start.append([*ols, resid])
        spread.append([*np.maximum(np.abs(ols) * 0.05, 0.01 * resid), 0.1 * resid])
    wide = np.array(scatter)[:, None]
    fixed = 0.0 if sigma is None else d[sigma] ** 2

    def density(p: np.ndarray) -> np.ndarray:
        prior = sum(_normal(p[..., i], 10.0 if i < physical else 1.0) for i in range(len(names))) + _normal(p[..., -2], 100.0) + _half_normal(p[..., -1], 10 * wide)
        return prior + d.gauss(d[y] - _terms(p, *cols), fixed + p[..., -1, None] ** 2 + 1e-300)

    return Model([*names, "const", "extra"], np.array(start), np.array(spread), density)


#: Of ``mixed`` moves one in so many is differential evolution.
EVOLVE = 5


def sampled(model: Model, rngs: Sequence[np.random.Generator], walkers: int, burn: int, keep: int, moves: str) -> Iterator[np.ndarray]:
    """Points (series, walkers, parameters) after each kept step: an ensemble for every series, all moved at once.

    Each series has a generator of its own, so that its chain does not depend on the series beside it. With ``mixed`` moves every fifth step is
    differential evolution.
    """
    count, dim = model.start.shape
    walkers = max(walkers, 2 * dim + 2) // 2 * 2
    half, block = walkers // 2, 20 * EVOLVE
    each = lambda draw: np.stack([draw(g) for g in rngs])

    def density(x: np.ndarray) -> np.ndarray:
        lp = model.log_density(x)
        return np.where(np.isnan(lp), -np.inf, lp)

    with np.errstate(all="ignore"):
        x = model.start[:, None] + model.spread[:, None] * each(lambda g: g.normal(size=(walkers, dim)))
        lp = density(x)
        for _ in range(200):
            bad = ~np.isfinite(lp)
            if not bad.any():
                break
            for i in np.flatnonzero(bad.any(axis=1)):
                x[i] = np.where(bad[i, :, None], model.start[i] + 0.3 * model.spread[i] * rngs[i].normal(size=(walkers, dim)), x[i])
            lp = np.where(bad, density(x), lp)
        for step in range(burn + keep):
            k = step % block
            if k == 0:
                z = (1 + each(lambda g: g.random((block, 2, half)))) ** 2 / 2
                luck, partner = np.log(each(lambda g: g.random((block, 2, half)))), each(lambda g: g.integers(0, half, (block, 2, half)))
                if moves == "mixed":
                    rounds = block // EVOLVE
                    far_jump, pairs = each(lambda g: g.random((rounds, 2))) < 0.1, each(lambda g: g.integers(0, half, (rounds, 2, 2, half)))
                    jitter = each(lambda g: g.normal(size=(rounds, 2, half, dim)))
            for side in (0, 1):
                own, other = x[:, side * half : (side + 1) * half], x[:, (1 - side) * half : (2 - side) * half]
                if moves == "mixed" and k % EVOLVE == EVOLVE - 1:
                    e = k // EVOLVE
                    a, b = (np.take_along_axis(other, pairs[:, e, side, i, :, None], 1) for i in (0, 1))
                    gain = np.where(far_jump[:, e, side], 1.0, 2.38 / math.sqrt(2 * dim))[:, None, None]
                    new, factor = own + gain * (a - b) + 1e-5 * model.spread[:, None] * jitter[:, e, side], 0.0
                else:
                    far = z[:, k, side, :, None]
                    new = np.take_along_axis(other, partner[:, k, side, :, None], 1) * (1 - far) + far * own
                    factor = (dim - 1) * np.log(far[..., 0])
                lp_own = lp[:, side * half : (side + 1) * half]
                lp_new = density(new)
                take = luck[:, k, side] < lp_new - lp_own + factor
                x[:, side * half : (side + 1) * half] = np.where(take[..., None], new, own)
                lp[:, side * half : (side + 1) * half] = np.where(take, lp_new, lp_own)
            if step >= burn:
                yield x


#: Series whose chains one task moves at once; blocks of a chain whose moments are kept.
SERIES, BLOCKS = 16, 20


def chains(df: DataFrame, model: Callable[[Batch], Model], by: Sequence[str], columns: Sequence[str] = ("t", "temp", "level", "sigma"), walkers: int = 32, burn: int = 500, keep: int = 600, count: int = 4, draws: int = 1000, seed: int = 0, moves: str = "stretch") -> DataFrame:
    """Independent chains of every series, each in a task (with those of at most some ``SERIES`` other series): a written table with a row per block of a chain.

    (by..., chain, block, params, n, mean, m2, draws): the block's number of points, their means and sums of squared deviations over all its steps, and
    points thinned to ``draws`` a chain. Rows with a null are left out.
    """
    keys = list(by)
    rows = df.select(*keys, *columns).dropna(subset=list(columns))
    batches = max(1, -(-rows.select(*keys).distinct().count() // SERIES))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = rows.withColumn("_chain", numbers).withColumn("_batch", F.pmod(F.xxhash64(*keys), F.lit(batches)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        chain = int(key[1])
        groups = [(k, g[list(columns)].sort_values(columns[0])) for k, g in pdf.groupby(keys, sort=True, dropna=False)]
        made = model(Batch([g for _, g in groups]))
        # a chain is seeded by its series' key
        rngs = [np.random.default_rng([seed, chain, zlib.crc32(repr(tuple(str(x) for x in k)).encode())]) for k, _ in groups]
        size, out, held = max(1, keep // BLOCKS), [], []
        every = None
        for step, x in enumerate(sampled(made, rngs, walkers, burn, size * BLOCKS, moves)):
            held.append(x.copy())
            if (step + 1) % size:
                continue
            points = np.stack(held, axis=1).reshape(len(groups), -1, x.shape[-1])
            every = every or max(1, points.shape[1] * BLOCKS // draws)
            mean = points.mean(axis=1)
            m2 = ((points - mean[:, None]) ** 2).sum(axis=1)
            out += [(*k, chain, step // size, made.names, points.shape[1], mean[i].tolist(), m2[i].tolist(), points[i, ::every].tolist()) for i, (k, _) in enumerate(groups)]
            held.clear()
        return pd.DataFrame(out, columns=[*keys, "chain", "block", "params", "n", "mean", "m2", "draws"])

    schema = _fields(df, keys) + "chain int, block int, params array<string>, n long, mean array<double>, m2 array<double>, draws array<array<double>>"
    path = shared_folder(df.sparkSession, "chains")
    # a number of partitions of its own: the rows are few and their work is long, so that they must not be put together
    dealt.repartition(2 * batches * count, "_batch", "_chain").groupBy("_batch", "_chain").applyInPandas(run, schema).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def diagnostics(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., param, mean, std, r_hat, ess) of chains, by merging the moments of their blocks.

    R-hat compares the halves of all chains; the effective size is that of the blocks' means.
    """
    keys = [*by, "param"]
    wide = blocks.select(*by, "chain", "block", "n", F.explode(F.arrays_zip("params", "mean", "m2")).alias("z"))
    wide = wide.select(*by, "chain", "n", F.floor(F.col("block") * 2 / BLOCKS).alias("half"), F.col("z.params").alias("param"), F.col("z.mean").alias("m"), F.col("z.m2").alias("m2"))
    # deviations from the series' own mean keep the sums of squares small
    centre = wide.groupBy(*keys).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("centre"))
    wide = wide.join(centre, keys).withColumn("d", F.col("m") - F.col("centre"))
    parts = wide.groupBy(*keys, "centre", "chain", "half").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("d"), F.sum("m2").alias("inner"), F.sum(F.col("n") * F.col("d") * F.col("d")).alias("outer"),
        F.sum("d").alias("s1"), F.sum(F.col("d") * F.col("d")).alias("s2"), F.count(F.lit(1)).alias("blocks"),
    )
    within = F.avg((F.col("inner") + F.col("outer") - F.col("n") * F.col("d") * F.col("d")) / (F.col("n") - 1))
    pooled = (1 - 1 / F.avg("n")) * within + F.var_samp("d")
    spread = (F.sum("s2") - F.sum("s1") * F.sum("s1") / F.sum("blocks")) / (F.sum("blocks") - 1)
    out = parts.groupBy(*keys).agg(F.first("centre").alias("mean"), F.sqrt(pooled).alias("std"), F.sqrt(pooled / within).alias("r_hat"), F.least(F.sum("blocks") * pooled / spread, F.sum("n").cast("double")).alias("ess"))
    return out.select(*keys, "mean", "std", "r_hat", "ess")


def calibrate(df: DataFrame, model: Callable[[Batch], Model], by: Sequence[str], columns: Sequence[str] = ("t", "temp", "level", "sigma"), **options) -> DataFrame:
    """Posterior draws of each series: (by..., draw, param, value, r_hat, ess); options as in ``chains``."""
    blocks = chains(df, model, by, columns, **options)
    points = blocks.select(*by, "chain", "block", "params", F.posexplode("draws").alias("place", "point"))
    draw = F.struct("chain", "block", "place")
    points = points.withColumn("draw", F.row_number().over(Window.partitionBy(*by).orderBy(draw)) - 1)
    long = points.select(*by, F.col("draw").cast("long").alias("draw"), F.explode(F.arrays_zip(F.col("params").alias("param"), F.col("point").alias("value"))).alias("z")).select(*by, "draw", "z.param", "z.value")
    return long.join(diagnostics(blocks, by).select(*by, "param", "r_hat", "ess"), [*by, "param"])


def conjugate(df: DataFrame, by: Sequence[str], scales: Sequence[float]) -> DataFrame:
    """Mean and deviation (by..., param, mean, std) of the posterior of ``normal_model``, whose normal equations are sums over a series' rows."""
    x = sequence.cumulative_trapezoid(df, "temp", "t", "x1", by).withColumn("x2", F.col("t") - F.min("t").over(Window.partitionBy(*by))).withColumn("x3", F.lit(1.0))
    w = F.col("sigma") * F.col("sigma")
    sums = {f"a{i}{j}": F.sum(F.col(f"x{i}") * F.col(f"x{j}") / w) + (1 / scales[i - 1] ** 2 if i == j else 0.0) for i in (1, 2, 3) for j in range(i, 4)}
    sums |= {f"b{i}": F.sum(F.col(f"x{i}") * F.col("level") / w) for i in (1, 2, 3)}
    m = x.groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()])
    a = {(i, j): F.col(f"a{min(i, j)}{max(i, j)}") for i in (1, 2, 3) for j in (1, 2, 3)}
    minor = lambda i, j: (lambda p, q: a[p[0], q[0]] * a[p[1], q[1]] - a[p[0], q[1]] * a[p[1], q[0]])([k for k in (1, 2, 3) if k != i], [k for k in (1, 2, 3) if k != j])
    m = m.withColumn("det", sum((-1) ** (1 + j) * a[1, j] * minor(1, j) for j in (1, 2, 3)))
    inverse = lambda i, j: (-1) ** (i + j) * minor(i, j) / F.col("det")
    rows = [F.struct(F.lit(n).alias("param"), sum(inverse(i, j) * F.col(f"b{j}") for j in (1, 2, 3)).alias("mean"), F.sqrt(inverse(i, i)).alias("std")) for i, n in enumerate(("b", "c", "h0"), 1)]
    return m.select(*by, F.explode(F.array(*rows)).alias("z")).select(*by, "z.*")


def posterior_summary(posterior: DataFrame, by: Sequence[str]) -> DataFrame:
    """Median, 3rd and 97th percentile, mean and deviation of each parameter, and whether it has converged (R-hat <= 1.05, ESS >= 100)."""
    out = posterior.groupBy(*by, "param").agg(F.percentile("value", [0.03, 0.5, 0.97]).alias("q"), F.avg("value").alias("mean"), F.stddev("value").alias("std"), F.max("r_hat").alias("r_hat"), F.min("ess").alias("ess"))
    return out.select(*by, "param", F.col("q")[1].alias("median"), F.col("q")[0].alias("p03"), F.col("q")[2].alias("p97"), "mean", "std", "r_hat", "ess", ((F.col("r_hat") <= 1.05) & (F.col("ess") >= 100)).alias("converged"))


def chain_summary(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """``posterior_summary`` of written ``chains``: quantiles of the thinned draws, of which a series has a set number, and moments of all points."""
    draws = blocks.groupBy(*by).agg(F.flatten(F.collect_list("draws")).alias("d"), F.first("params").alias("params"))
    each = draws.select(*by, "d", F.posexplode("params").alias("i", "param"))
    values = each.select(*by, "param", F.sort_array(F.expr("transform(d, x -> x[i])")).alias("v"))

    def quantile(q: float):
        at = (F.size("v") - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        a, b = F.get("v", low), F.get("v", F.least(low + 1, F.size("v") - 1))
        return a + (b - a) * (at - low)

    out = values.select(*by, "param", quantile(0.5).alias("median"), quantile(0.03).alias("p03"), quantile(0.97).alias("p97")).join(diagnostics(blocks, by), [*by, "param"])
    return out.withColumn("converged", (F.col("r_hat") <= 1.05) & (F.col("ess") >= 100))


def posterior_wide(posterior: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per draw with a column per parameter."""
    return posterior.groupBy(*by, "draw").agg(*[F.max(F.when(F.col("param") == n, F.col("value"))).alias(n) for n in names])


def posterior_paths(posterior: DataFrame, design: DataFrame, shapes: dict[str, str], by: Sequence[str], t: str, n_draw: int = 500) -> DataFrame:
    """Paths of a linear model for the first draws: sum of parameter times design column (1 for ``h0``)."""
    wide = posterior_wide(posterior.filter(F.col("draw") < n_draw), by, [*shapes, "h0"])
    grid = wide.join(design, list(by)) if by else wide.crossJoin(F.broadcast(design))
    value = sum((F.col(p) * F.col(c) for p, c in shapes.items()), F.col("h0"))
    return grid.select(*by, "draw", t, value.alias("value"))


def dynamic_design_of(df: DataFrame, level: str, temp: str, t: str, by: Sequence[str], order: int = 2, n_lags: int = 2, sigma: str | None = None) -> tuple[DataFrame, Callable[[Batch], Model], list[str]]:
    """Rows, model and columns of the static dynamic regression, for ``chains``; coefficients are those of the z-scored design."""
    from .regress import dynamic_design

    design, names = dynamic_design(df, temp, t, order, n_lags, None, by)
    columns = list(dict.fromkeys(["t", level, *names, *([sigma] if sigma else [])]))
    return design.withColumn("t", F.col(t)), lambda d: linear_model(d, level, names, order + 1, sigma), columns


def calibrate_dynamic(df: DataFrame, level: str, temp: str, t: str, by: Sequence[str], order: int = 2, n_lags: int = 2, sigma: str | None = None, **options) -> DataFrame:
    """Posterior draws of the static dynamic regression."""
    design, model, columns = dynamic_design_of(df, level, temp, t, by, order, n_lags, sigma)
    return calibrate(design, model, by, columns, **options)


def kalman(x: np.ndarray, y: np.ndarray, r: np.ndarray, q: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Random-walk coefficients: log-likelihood, filtered means and covariances (Joseph form, start N(0, 100 I))."""
    n, k = x.shape
    m, p = np.zeros(k), 100.0 * np.eye(k)
    means, covs, ll = np.empty((n, k)), np.empty((n, k, k)), 0.0
    for i in range(n):
        p = p + np.diag(q)
        h = x[i]
        s = float(h @ p @ h + r[i])
        v = float(y[i] - h @ m)
        gain = p @ h / s
        m = m + gain * v
        keep = np.eye(k) - np.outer(gain, h)
        p = keep @ p @ keep.T + np.outer(gain, gain) * r[i]
        ll -= 0.5 * (math.log(2 * math.pi * s) + v * v / s)
        means[i], covs[i] = m, p
    return ll, means, covs


def smoothed(means: np.ndarray, covs: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rauch-Tung-Striebel smoother of a random walk."""
    ms, ps = means.copy(), covs.copy()
    for i in range(len(means) - 2, -1, -1):
        ahead = covs[i] + np.diag(q)
        g = np.linalg.solve(ahead, covs[i]).T
        ms[i] = means[i] + g @ (ms[i + 1] - means[i])
        ps[i] = covs[i] + g @ (ps[i + 1] - ahead) @ g.T
    return ms, ps


def dynamic_linear(df: DataFrame, y: str, xs: Sequence[str], t: str, by: Sequence[str], sigma: str, draws: int = 100, seed: int = 0) -> DataFrame:
    """Time-varying coefficients: posterior of the log walk variances, and the smoother over some of its draws.

    Rows (by..., t, term, mean, low, high) with 94 % intervals.
    """
    xs, keys = list(xs), list(by)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values(t)
        x, v, r = pdf[xs].to_numpy(float), pdf[y].to_numpy(float), pdf[sigma].to_numpy(float) ** 2
        density = lambda p: kalman(x, v, r, np.exp(np.clip(p, -40, 5)))[0] + sum(_normal(k + 10, 4.0) for k in p)
        chain = sample(density, np.full(len(xs), -10.0), np.full(len(xs), 1.0), 8, 40, 60, 2, seed).reshape(-1, len(xs))
        rng = np.random.default_rng(seed)
        paths = []
        for p in chain[rng.choice(len(chain), min(draws, len(chain)), replace=False)]:
            q = np.exp(np.clip(p, -40, 5))
            _, m, c = kalman(x, v, r, q)
            m, c = smoothed(m, c, q)
            paths.append(m + np.sqrt(np.clip(np.diagonal(c, axis1=1, axis2=2), 0, None)) * rng.normal(size=m.shape))
        paths = np.array(paths)
        rows = [(*key, float(pdf[t].iloc[i]), xs[k], float(paths[:, i, k].mean()), *interval(paths[:, i, k])) for i in range(len(pdf)) for k in range(len(xs))]
        return pd.DataFrame(rows, columns=[*keys, t, "term", "mean", "low", "high"])

    return df.select(*keys, t, y, *xs, sigma).groupBy(*keys).applyInPandas(run, _fields(df, keys) + f"`{t}` double, term string, mean double, low double, high double")


def hierarchical(estimates: DataFrame, group: str, coef: str, se: str, by: Sequence[str] = (), seed: int = 0, keep: int = 600) -> DataFrame:
    """Population mean and spread of groups' coefficients, and each group's own, shrunk (non-centred).

    Rows (by..., param, mean, low, high); parameters mu, tau, theta[<group>].
    """
    keys = list(by)
    table = estimates if keys else estimates.withColumn("_one", F.lit(1))
    keys_in = keys or ["_one"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values(group)
        y, s = pdf[coef].to_numpy(float), pdf[se].to_numpy(float)
        wide = max(float(y.std()), float(s.mean()), 1e-12)

        def density(p: np.ndarray) -> float:
            if p[1] < 0:
                return -math.inf
            return _normal(p[0] - y.mean(), 10 * wide) + _half_cauchy(p[1], wide) - 0.5 * float(p[2:] @ p[2:]) + _gauss(y - p[0] - p[1] * p[2:], s**2)

        start = np.concatenate([[y.mean(), 0.5 * wide], np.zeros(len(y))])
        chain = sample(density, start, np.concatenate([[0.1 * wide, 0.1 * wide], np.full(len(y), 0.3)]), 4 * len(y) + 8, 300, keep, 2, seed)
        flat = chain.reshape(-1, chain.shape[-1])
        draws = {"mu": flat[:, 0], "tau": flat[:, 1]} | {f"theta[{g}]": flat[:, 0] + flat[:, 1] * flat[:, 2 + i] for i, g in enumerate(pdf[group])}
        rows = [(*(key if keys else ()), n, float(v.mean()), *interval(v)) for n, v in draws.items()]
        return pd.DataFrame(rows, columns=[*keys, "param", "mean", "low", "high"])

    return table.select(*keys_in, group, coef, se).groupBy(*keys_in).applyInPandas(run, _fields(estimates, keys) + "param string, mean double, low double, high double")


def design_vectors(df: DataFrame, temp: str, t: str, by: Sequence[str]) -> DataFrame:
    """I2, I1, I0 of the level model in SQL, for paths of posterior draws."""
    out = sequence.cumulative_powers(df, temp, t, 2, by)
    return out.withColumn("i0", F.col(t) - F.min(t).over(sequence.Window.partitionBy(*by))).withColumnRenamed("cum_t1", "i1").withColumnRenamed("cum_t2", "i2")
