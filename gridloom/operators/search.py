"""Search strategies: how the nearest neurons of a block of rows are found.

``bmu.assign`` and ``bmu.top_units`` take any of these in place of a distance's name.  A strategy is pickled
to the workers with its weights, so it holds arrays and no handles.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np

from gridloom.functions.distances import nearest


class SearchStrategy(ABC):
    """The interface for own search backends, such as an index over the neurons."""

    @abstractmethod
    def rebuild(self, weights: np.ndarray) -> None:
        """Take new weights, (K, F)."""

    @abstractmethod
    def search(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances, (B, k) each, of the k nearest neurons of rows (B, F), nearest first."""


class BruteForce(SearchStrategy):
    """All neurons, by a distance of the registry or an own one."""

    def __init__(self, distance: str | Callable = "euclidean"):
        self.distance, self.weights = distance, np.zeros((0, 0))

    def rebuild(self, weights: np.ndarray) -> None:
        self.weights = weights

    def search(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return nearest(x, self.weights, self.distance, k)


class ProjectionIndex(SearchStrategy):
    """Euclidean search that skips neurons by one projection: |p(x) - p(w)| is never more than their distance.

    Neurons are sorted along their direction of largest spread and looked at from a row's place outwards, in
    steps of ``step``, until the projections alone are farther than the k-th best.
    """

    def __init__(self, step: int = 64):
        self.step = step

    def rebuild(self, weights: np.ndarray) -> None:
        self.mean = weights.mean(axis=0)
        self.axis = np.linalg.svd(weights - self.mean, full_matrices=False)[2][0] if len(weights) > 1 else np.eye(1, weights.shape[1])[0]
        place = (weights - self.mean) @ self.axis
        self.order = np.argsort(place, kind="stable")
        self.place, self.sorted = place[self.order], weights[self.order]

    def search(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        k = min(k, len(self.order))
        ids, dists = np.empty((len(x), k), np.int64), np.empty((len(x), k))
        for row, (v, p) in enumerate(zip(x, (x - self.mean) @ self.axis, strict=True)):
            low = high = int(np.searchsorted(self.place, p))
            found, d = np.zeros(0, np.int64), np.zeros(0)
            while low > 0 or high < len(self.order):
                worst = d[k - 1] if len(d) >= k else np.inf
                new = []
                if low > 0 and p - self.place[low - 1] <= worst:
                    new.append(np.arange(max(0, low - self.step), low))
                    low = int(new[-1][0])
                else:
                    low = 0
                if high < len(self.order) and self.place[high] - p <= worst:
                    new.append(np.arange(high, min(len(self.order), high + self.step)))
                    high = int(new[-1][-1]) + 1
                else:
                    high = len(self.order)
                if new:
                    at = np.concatenate(new)
                    found = np.concatenate((found, self.order[at]))
                    d = np.concatenate((d, np.sqrt(((self.sorted[at] - v) ** 2).sum(axis=1))))
                    best = np.lexsort((found, d))[:k]
                    found, d = found[best], d[best]
            ids[row], dists[row] = found, d
        return ids, dists
