"""Reproducible draws: uniforms by hashing ids, and what is made of them.

A draw depends on its stream and sample id alone, so it survives any partitioning and is
shared by scenarios when the scenario is not part of the stream.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import stats
from .scalars import col


def uniform(stream: str, *ids: Column | str) -> Column:
    """In (0, 1): 53 bits of the hash of the stream and the ids."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(stream), *[col(i) for i in ids]), 11)
    return (bits.cast("double") + 0.5) / float(2**53)


def normal(stream: str, *ids: Column | str, mean: Column | float = 0.0, sigma: Column | float = 1.0) -> Column:
    """Box-Muller from two streams."""
    z = F.sqrt(-2 * F.log(uniform(stream + "/r", *ids))) * F.cos(2 * math.pi * uniform(stream + "/a", *ids))
    return mean + sigma * z


def lognormal(stream: str, *ids: Column | str, mu: Column | float = 0.0, sigma: Column | float = 1.0) -> Column:
    return F.exp(normal(stream, *ids, mean=mu, sigma=sigma))


def exponential(stream: str, *ids: Column | str, scale: float = 1.0) -> Column:
    return -scale * F.log(uniform(stream, *ids))


def skew_normal(stream: str, *ids: Column | str, alpha: float = 0.0) -> Column:
    """Standard skew-normal: delta |z1| + sqrt(1 - delta^2) z2."""
    delta = alpha / math.sqrt(1 + alpha * alpha)
    return delta * F.abs(normal(stream + "/1", *ids)) + math.sqrt(1 - delta * delta) * normal(stream + "/2", *ids)


def log_skew_normal(stream: str, *ids: Column | str, low: float, high: float, alpha: float = 0.0) -> Column:
    """Positive draws whose logarithm is skew-normal with 5th and 95th percentiles log(low) and log(high)."""
    a, b = stats.skew_normal_quantile(0.05, alpha), stats.skew_normal_quantile(0.95, alpha)
    scale = (math.log(high) - math.log(low)) / (b - a)
    return F.exp(math.log(low) - scale * a + scale * skew_normal(stream, *ids, alpha=alpha))


def choice(stream: str, *ids: Column | str, weights: Sequence[float]) -> Column:
    """Index of a category, by cumulative weights."""
    u, total, acc = uniform(stream, *ids), float(sum(weights)), 0.0
    out = F.lit(len(weights) - 1)
    edges = []
    for w in weights[:-1]:
        acc += w / total
        edges.append(acc)
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(u < edges[i], i).otherwise(out)
    return out


def multivariate(stream: str, *ids: Column | str, mean: Sequence[float], cov: Sequence[Sequence[float]]) -> list[Column]:
    """Correlated normals through the root of an eigenvalue-clipped covariance."""
    values, vectors = np.linalg.eigh(np.asarray(cov, float))
    root = vectors * np.sqrt(np.clip(values, 0, None))
    z = [normal(f"{stream}/{k}", *ids) for k in range(len(mean))]
    out = []
    for i, m in enumerate(mean):
        c = F.lit(float(m))
        for k, zk in enumerate(z):
            c = c + float(root[i, k]) * zk
        out.append(c)
    return out
