"""Codebook initialisation: unit vectors, sampled rows, or the plane of two principal components."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.config import MapConfig
from gridloom.functions.lattice import ROOT3
from gridloom.operators.bmu import vectors_of
from gridloom.operators.prepare import folded, shuffle_key


def unit_vectors(config: MapConfig, features: int) -> np.ndarray:
    w = 2 * np.random.default_rng(config.seed).standard_normal((config.neurons, features)) - 1
    return w / np.maximum(np.linalg.norm(w, axis=1), 1e-12)[:, None]


def sample_rows(df: DataFrame, config: MapConfig, features: str = "features", row_id: str = "row_id") -> np.ndarray:
    """Neurons as data rows without replacement: the first K in the shuffled order of their ids.

    Fewer rows than neurons are gone through again and again.
    """
    order = shuffle_key(F.col(row_id).cast("long"), 0, config.seed)
    rows = [r[0] for r in df.orderBy(order, row_id).select(features).limit(config.neurons).collect()]
    if not rows:
        raise ValueError("there are no rows to start from")
    return np.array(rows, dtype=float)[np.arange(config.neurons) % len(rows)]


def moments(df: DataFrame, features: str = "features") -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, column sums and Gram matrix: one pass of F x F partial sums, added on executors."""

    def packed(n: int, total: np.ndarray, gram: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary()), pa.array([gram.tobytes()], pa.binary())], names=["n", "total", "gram"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, 0.0, 0.0
        for batch in batches:
            x = vectors_of(batch.column(0))
            if len(x):
                n, total, gram = n + len(x), total + x.sum(axis=0), gram + x.T @ x
        if n:
            yield packed(n, total, gram)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, 0.0, 0.0
        for batch in batches:
            for r in batch.to_pylist():
                n, total, gram = n + r["n"], total + np.frombuffer(r["total"]), gram + np.frombuffer(r["gram"])
        if n:
            yield packed(n, total, gram)

    schema = "n long, total binary, gram binary"
    rows = folded(df.select(features).mapInArrow(run, schema), fold, schema).collect()
    if not rows:
        raise ValueError("there are no rows")
    total = sum(np.frombuffer(bytes(r["total"])) for r in rows)
    gram = sum(np.frombuffer(bytes(r["gram"])) for r in rows).reshape(len(total), -1)
    return sum(r["n"] for r in rows), total, gram


def covariance(n: int, total: np.ndarray, gram: np.ndarray) -> np.ndarray:
    mean = total / n
    return (gram - n * np.outer(mean, mean)) / (n - 1)


def pca_plane(config: MapConfig, n: int, total: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Weights on the plane of the first two components, scaled to the data's overall deviation.

    A component's sign is fixed by making its largest loading positive.
    """
    features = len(total)
    mean = total / n
    _, _, v = np.linalg.svd(covariance(n, total, gram))
    pc = v[:2] * np.sign(v[:2][np.arange(2), np.abs(v[:2]).argmax(axis=1)])[:, None]
    row, col = np.divmod(np.arange(config.neurons), config.y)
    gx = np.linspace(-1, 1, config.x)[row] if config.x > 1 else np.full(config.neurons, -1.0)
    gy = np.linspace(-1, 1, config.y)[col] if config.y > 1 else np.full(config.neurons, -1.0)
    if config.topology == "hexagonal":
        gx, gy = gx + 0.5 * (row & 1), gy * ROOT3 / 2
    w = gx[:, None] * pc[0] + gy[:, None] * pc[1]
    spread = w.std(ddof=1)
    if spread > 0:
        cells = n * features
        overall = np.sqrt(max((np.trace(gram) - total.sum() ** 2 / cells) / (cells - 1), 0.0))
        w *= overall / spread
    return w + mean


def initial_weights(df: DataFrame, config: MapConfig, mode: str | None = None, features: str = "features", row_id: str = "row_id") -> np.ndarray:
    """(K, F) weights by mode: "random" (data rows), "pca", or "none" (unit vectors)."""
    mode = mode or config.init
    if mode == "random":
        return sample_rows(df, config, features, row_id)
    if mode == "none":
        return unit_vectors(config, len(df.select(features).first()[0]))
    if mode != "pca":
        raise ValueError(f"unknown initialization {mode!r}")
    n, total, gram = moments(df, features)
    if len(total) < 2:
        raise ValueError("principal components need at least two features")
    if min(config.x, config.y) == 1:
        warnings.warn("principal components suit maps with two dimensions", stacklevel=2)
    if n < 2:
        warnings.warn("principal components need two rows; starting from rows instead", stacklevel=2)
        return sample_rows(df, config, features, row_id)
    return pca_plane(config, n, total, gram)
