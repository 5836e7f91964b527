"""Distance kernels: NumPy kernels for batches and Column builders for pairs. Dimensions add up in index order in both."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "sqeuclidean", "cosine", "sqcosine", "cityblock", "chebyshev", "minkowski")


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        out += a[:, d, None] * b[None, :, d]
    return out


def _norms(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * a[:, d]
    return np.sqrt(out)


def pairwise(a: np.ndarray, b: np.ndarray, metric: str = "euclidean", p: float = 2.0, weights: list[float] | None = None) -> np.ndarray:
    """Distances [row of a, row of b]. weights apply to the additive metrics and to chebyshev."""
    if metric in ("cosine", "sqcosine"):
        both = _norms(a)[:, None] * _norms(b)[None, :]
        cos = np.divide(_inner(a, b), both, out=np.zeros_like(both), where=both > 0)
        return 1 - cos if metric == "cosine" else np.clip(2 * (1 - cos), 0.0, 4.0)
    w = [1.0] * a.shape[1] if weights is None else weights
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        x = a[:, d, None] - b[None, :, d]
        if metric in ("euclidean", "sqeuclidean"):
            out += w[d] * (x * x)
        elif metric == "cityblock":
            out += w[d] * np.abs(x)
        elif metric == "chebyshev":
            np.maximum(out, w[d] * np.abs(x), out=out)
        elif metric == "minkowski":
            out += w[d] * np.abs(x) ** p
        else:
            raise ValueError(f"unknown metric {metric}")
    return np.sqrt(out) if metric == "euclidean" else out ** (1 / p) if metric == "minkowski" else out


def aligned(a: np.ndarray, b: np.ndarray, metric: str = "euclidean", p: float = 2.0, rows: int = 65_536) -> np.ndarray:
    """Distances of row i of a to row i of b, added up as pairwise does."""
    out = np.zeros(len(a))
    for s in range(0, len(a), rows):
        x, y, t = a[s : s + rows], b[s : s + rows], out[s : s + rows]
        if metric in ("cosine", "sqcosine"):
            both = _norms(x) * _norms(y)
            for d in range(x.shape[1]):
                t += x[:, d] * y[:, d]
            cos = np.divide(t, both, out=np.zeros_like(both), where=both > 0)
            t[:] = 1 - cos if metric == "cosine" else np.clip(2 * (1 - cos), 0.0, 4.0)
            continue
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric}")
        for d in range(x.shape[1]):
            u = x[:, d] - y[:, d]
            if metric == "chebyshev":
                np.maximum(t, np.abs(u), out=t)
            else:
                t += np.abs(u) if metric == "cityblock" else np.abs(u) ** p if metric == "minkowski" else u * u
        if metric == "euclidean":
            np.sqrt(t, out=t)
        elif metric == "minkowski":
            t **= 1 / p
    return out


def gemm_sqeuclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by the inner-product identity, not below zero; faster, with other rounding."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def distance(a: Column | str, b: Column | str, metric: str = "euclidean", p: float = 2.0, weights: list[float] | None = None) -> Column:
    """The distance of two array<double> columns."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    if metric in ("cosine", "sqcosine"):
        dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
        both = F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda x: x * x)))
        cos = F.when(both > 0, F.try_divide(dot, both)).otherwise(F.lit(0.0))
        return 1 - cos if metric == "cosine" else F.greatest(F.lit(0.0), F.least(F.lit(4.0), 2 * (1 - cos)))
    x = F.zip_with(a, b, lambda u, v: u - v)
    if weights is not None:
        scale = F.array(*[F.lit(float(w)) for w in weights])
        terms = {"euclidean": lambda u, w: w * (u * u), "sqeuclidean": lambda u, w: w * (u * u), "cityblock": lambda u, w: w * F.abs(u), "chebyshev": lambda u, w: w * F.abs(u), "minkowski": lambda u, w: w * F.pow(F.abs(u), F.lit(p))}[metric]
        t = F.zip_with(x, scale, terms)
    else:
        one = {"euclidean": lambda u: u * u, "sqeuclidean": lambda u: u * u, "cityblock": F.abs, "chebyshev": F.abs, "minkowski": lambda u: F.pow(F.abs(u), F.lit(p))}[metric]
        t = F.transform(x, one)
    if metric == "chebyshev":
        return F.array_max(t)
    total = _sum(t)
    return F.sqrt(total) if metric == "euclidean" else F.pow(total, F.lit(1 / p)) if metric == "minkowski" else total
