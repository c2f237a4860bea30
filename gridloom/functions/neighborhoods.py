"""Neighborhood kernels of the squared lattice distance, for numbers, arrays and Columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _of(d2):
    return F if isinstance(d2, Column) else np


def gaussian(d2, s: float):
    return _of(d2).exp(-d2 / (2 * s * s))


def mexican_hat(d2, s: float):
    """Scaled to 1 at the centre; negative beyond a distance of two radii."""
    return (1 - 0.25 * d2 / (s * s)) * _of(d2).exp(-d2 / (2 * s * s))


def bubble(d2, s: float):
    inside = d2 <= s * s
    return inside.cast("double") if isinstance(d2, Column) else inside.astype(float)


def triangle(d2, s: float):
    if isinstance(d2, Column):
        return F.greatest(s - F.sqrt(d2), F.lit(0.0)) / s
    return np.maximum(s - np.sqrt(d2), 0.0) / s


NEIGHBORHOODS: dict[str, Callable] = {"gaussian": gaussian, "mexican_hat": mexican_hat, "bubble": bubble, "triangle": triangle}
