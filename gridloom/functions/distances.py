"""Distances under one name as a Column builder (SQL path) and as a NumPy kernel (Arrow path).

A kernel takes (B, F) rows and (K, F) neurons and gives (B, K); adding a key to ``COLUMNS`` or
``KERNELS`` adds a distance.  Cosine distance is clamped to [0, 1], so all obtuse pairs tie at 1.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q))))


def cosine(a: Column, b: Column) -> Column:
    scale = F.greatest(norm(a), F.lit(TINY)) * F.greatest(norm(b), F.lit(TINY))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - dot(a, b) / scale))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: F.abs(p - q)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda p, q: F.abs(p - q)))


COLUMNS: dict[str, Callable[[Column, Column], Column]] = {"euclidean": euclidean, "cosine": cosine, "manhattan": manhattan, "chebyshev": chebyshev}


def _expanded(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Squared distances by |x|^2 + |w|^2 - 2 x.w; close to zero they hold rounding noise."""
    d = x @ w.T
    d *= -2.0
    d += (x * x).sum(axis=1)[:, None]
    d += (w * w).sum(axis=1)[None, :]
    return np.maximum(d, 0.0, out=d)


def _by_feature(x: np.ndarray, w: np.ndarray, fold: Callable) -> np.ndarray:
    """One (B, K) pass for each feature: no (B, K, F) temporary."""
    d = np.zeros((len(x), len(w)))
    for f in range(x.shape[1]):
        fold(d, np.abs(x[:, f, None] - w[None, :, f]), out=d)
    return d


def _cosine(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    a = x / np.maximum(np.sqrt((x * x).sum(axis=1)), TINY)[:, None]
    b = w / np.maximum(np.sqrt((w * w).sum(axis=1)), TINY)[:, None]
    return np.clip(1 - a @ b.T, 0.0, 1.0)


KERNELS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "euclidean": lambda x, w: np.sqrt(_expanded(x, w)),
    "cosine": _cosine,
    "manhattan": lambda x, w: _by_feature(x, w, np.add),
    "chebyshev": lambda x, w: _by_feature(x, w, np.maximum),
}

PAIRWISE: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum(axis=-1)),
    "cosine": lambda a, b: np.clip(1 - (a * b).sum(axis=-1) / (np.maximum(np.sqrt((a * a).sum(axis=-1)), TINY) * np.maximum(np.sqrt((b * b).sum(axis=-1)), TINY)), 0.0, 1.0),
    "manhattan": lambda a, b: np.abs(a - b).sum(axis=-1),
    "chebyshev": lambda a, b: np.abs(a - b).max(axis=-1),
}


def nearest(x: np.ndarray, w: np.ndarray, distance: str | Callable = "euclidean", k: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of each row's k nearest neurons, (B, k) each; ties go to the lowest id.

    Euclidean distances of the winners are computed again directly: the expanded form only picks them.
    """
    k = min(k, len(w))
    if callable(distance) or distance != "euclidean":
        d = distance(x, w) if callable(distance) else KERNELS[distance](x, w)
        return _smallest(np.array(d, dtype=float), k)
    d = _expanded(x, w)
    m = min(len(w), k + 3)
    near = np.argpartition(d, m - 1, axis=1)[:, :m] if m < len(w) else np.broadcast_to(np.arange(len(w)), d.shape).copy()
    near.sort(axis=1)
    exact = np.sqrt(((x[:, None, :] - w[near]) ** 2).sum(axis=2))
    at, found = _smallest(exact, k)
    ids = np.take_along_axis(near, at, axis=1)
    if m < len(w):
        margin = found[:, -1] ** 2 + 1e-9 * (1 + (x * x).sum(axis=1) + (w * w).sum(axis=1).max())
        close = (d <= margin[:, None]).sum(axis=1) > m  # more neurons than were looked at may tie
        for r in np.flatnonzero(close):
            one = np.sqrt(((x[r] - w) ** 2).sum(axis=1))[None, :]
            ids[r], found[r] = (v[0] for v in _smallest(one, k))
    return ids, found


def nearest_two(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two nearest neurons by Euclidean distance and the nearest's distance, for training.

    Neurons are compared by the expanded form alone, so exact ties are not settled by id.
    """
    d = x @ (-2.0 * w.T)
    d += (w * w).sum(axis=1)
    rows, ids = np.arange(len(x)), np.empty((len(x), 2), np.int64)
    ids[:, 0] = d.argmin(axis=1)
    d[rows, ids[:, 0]] = np.inf
    ids[:, 1] = d.argmin(axis=1) if len(w) > 1 else 0
    gap = x - w[ids[:, 0]]
    return ids, np.sqrt(np.einsum("ij,ij->i", gap, gap))


def _smallest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    ids, found, rows = np.empty((len(d), k), np.int64), np.empty((len(d), k)), np.arange(len(d))
    for i in range(k):
        ids[:, i] = d.argmin(axis=1)
        found[:, i] = d[rows, ids[:, i]]
        if i + 1 < k:
            d[rows, ids[:, i]] = np.inf
    return ids, found
