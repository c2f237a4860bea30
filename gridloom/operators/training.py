"""Training: one grouped sum for each epoch.

A full-batch update depends on the rows only through each neuron's count n and sum S of the rows it
wins: W += (lr / B) * (H'S - (H'n) * W), H being the neighborhood kernel.  So an epoch is one pass of
K x F partial sums.  The errors after update t come from the winners of pass t + 1, which makes T + 1
passes for T epochs.  The Gaussian kernel is a product over the axes and is applied axis by axis.

"local" collects the rows once and runs the same arithmetic in NumPy; "auto" takes it only below
``LOCAL_CELLS`` values, and gives the same weights either way.  The distributed path packs the rows once
into cached binary blocks; a pass reads those, and partial sums of many tasks are added on executors
before they reach the driver.  A mini-batch is a set of rows that ``prepare.batch_number`` names by their
ids, at every size and in both ways; an epoch deals the blocks by batch once, so a batch reads its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.config import MapConfig
from gridloom.functions.distances import nearest, nearest_two
from gridloom.functions.lattice import axis_distance_sq, offset_distance, torus_offset_distance
from gridloom.functions.neighborhoods import NEIGHBORHOODS
from gridloom.functions.schedules import schedules
from gridloom.operators.bmu import check_features, row_blocks, vectors_of
from gridloom.operators.codebook import initial_weights
from gridloom.operators.prepare import batch_number
from gridloom.operators.quality import ADJACENT

LOCAL_CELLS = 32_000_000
BLOCK_ROWS = 8192
MANY_TASKS = 64
Sums = tuple[np.ndarray, np.ndarray, float, float]  # rows by neuron, their sum, sum of distances, errors


def not_adjacent(a: np.ndarray, b: np.ndarray, config: MapConfig) -> np.ndarray:
    """Where two neurons are no grid neighbours."""
    (r1, c1), (r2, c2) = np.divmod(a, config.y), np.divmod(b, config.y)
    if config.topology == "hexagonal":
        return (torus_offset_distance(r1, c1, r2, c2, config.x, config.y) if config.pbc else offset_distance(r1, c1, r2, c2)) > 1
    dr, dc = (r1 - r2).astype(float), (c1 - c2).astype(float)
    if config.pbc:
        dr, dc = dr - config.x * np.round(dr / config.x), dc - config.y * np.round(dc / config.y)
    return np.hypot(dr, dc) > ADJACENT


def partial_sums(x: np.ndarray, w: np.ndarray, config: MapConfig) -> Sums:
    """What an update and the errors need of some rows."""
    n, s, d, e = np.zeros(len(w)), np.zeros_like(w), 0.0, 0.0
    for part in row_blocks(x, len(w)):
        if config.distance == "euclidean":
            ids, near = nearest_two(part, w)
        else:
            ids, dist = nearest(part, w, config.distance, 2)
            near = dist[:, 0]
        own = ids[:, 0]
        n += np.bincount(own, minlength=len(w))
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        s[own[order][first]] += np.add.reduceat(part[order], first, axis=0)
        d += float(near.sum())
        if len(w) > 1:
            e += float(not_adjacent(own, ids[:, 1], config).sum())
    return n, s, d, e


class Smoother:
    """Applies the neighborhood kernel of a radius to per-neuron sums."""

    def __init__(self, config: MapConfig):
        self.config = config
        self.dx, self.dy = axis_distance_sq(config.x, config.y, config.topology, config.pbc, config.hex_geometry)
        # both axes depend on row or column alone unless rows are staggered
        self.split = config.neighborhood == "gaussian" and not (config.topology == "hexagonal" and config.hex_geometry == "regular")
        self.d2 = None if self.split else self.dx + self.dy

    def __call__(self, values: np.ndarray, sigma: float) -> np.ndarray:
        c = self.config
        kernel = NEIGHBORHOODS[c.neighborhood]
        if not self.split:
            return kernel(self.d2, sigma).T @ values
        hx = kernel(self.dx[:: c.y, :: c.y], sigma)
        hy = kernel(self.dy[: c.y, : c.y], sigma)
        shaped = values.reshape(c.x, c.y, -1)
        half = np.tensordot(hx.T, shaped, axes=(1, 0))
        return np.einsum("cd,rdf->rcf", hy.T, half, optimize=True).reshape(values.shape)


def updated(w: np.ndarray, sums: Sums, smooth: Smoother, lr: float, sigma: float) -> np.ndarray:
    n, s = sums[0], sums[1]
    both = smooth(np.concatenate((s, n[:, None]), axis=1), sigma)
    return w + lr / n.sum() * (both[:, :-1] - both[:, -1:] * w)


def errors(sums: Sums) -> tuple[float, float]:
    total = sums[0].sum()
    return float(sums[2] / total), float(100.0 * sums[3] / total)


def fit_passes(one_pass: Callable[[np.ndarray], Sums], w: np.ndarray, config: MapConfig) -> tuple[np.ndarray, list[tuple[int, float, float]]]:
    """Full-batch training over any way to get the sums of a pass."""
    smooth, history = Smoother(config), []
    plan = schedules(config.epochs, (config.lr_decay, config.learning_rate), (config.sigma_decay, config.sigma))
    sums = one_pass(w)
    for epoch, (lr, sigma) in enumerate(plan):
        w = updated(w, sums, smooth, lr, sigma)
        sums = one_pass(w)
        history.append((epoch, *errors(sums)))
    return w, history


def fit_batches(batch_passes: Callable[[int], Iterator[Callable[[np.ndarray], Sums]]], w: np.ndarray, config: MapConfig) -> tuple[np.ndarray, list[tuple[int, float, float]]]:
    """Mini-batch training: sequential updates, errors on each batch after its update; ``batch_passes`` gives
    an epoch's batches as passes over their rows.  Batches without rows are left out."""
    smooth, history = Smoother(config), []
    plan = schedules(config.epochs, (config.lr_decay, config.learning_rate), (config.sigma_decay, config.sigma))
    for epoch, (lr, sigma) in enumerate(plan):
        found = []
        for one_pass in batch_passes(epoch):
            sums = one_pass(w)
            if sums[0].sum():
                w = updated(w, sums, smooth, lr, sigma)
                found.append(errors(one_pass(w)))
        history.append((epoch, *(float(v) for v in np.mean(found, axis=0))))
    return w, history


def local_batches(x: np.ndarray, ids: np.ndarray, batches: int, config: MapConfig) -> Callable[[int], Iterator[Callable[[np.ndarray], Sums]]]:
    def of(epoch: int) -> Iterator[Callable[[np.ndarray], Sums]]:
        batch = batch_number(ids, batches, epoch, config.seed)
        for b in range(batches):
            part = x[batch == b]
            yield lambda w, part=part: partial_sums(part, w, config)

    return of


def distributed_batches(blocks: DataFrame, batches: int, config: MapConfig, tasks: int) -> Callable[[int], Iterator[Callable[[np.ndarray], Sums]]]:
    """An epoch's blocks are cut and dealt by batch in one exchange and cached; reading one batch skips the
    cached parts of others by their statistics."""

    def of(epoch: int) -> Iterator[Callable[[np.ndarray], Sums]]:
        def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for n, block, ids in zip(*(part.column(c).to_pylist() for c in ("n", "block", "ids")), strict=True):
                    x = np.frombuffer(block).reshape(n, -1)
                    batch = batch_number(np.frombuffer(ids, np.int64), batches, epoch, config.seed)
                    for b in np.unique(batch).tolist():
                        own = x[batch == b]
                        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([len(own)]), pa.array([own.tobytes()], pa.binary())], names=["batch", "n", "block"])

        dealt = blocks.mapInArrow(cut, "batch int, n long, block binary").repartitionByRange(max(1, tasks), "batch").sortWithinPartitions("batch").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for b in range(batches):
                yield distributed_pass(dealt.filter(F.col("batch") == b), config, tasks)
        finally:
            dealt.unpersist()

    return of


def packed(df: DataFrame, features: str, row_id: str | None = None) -> DataFrame:
    """``n``, ``block`` (and ``ids``): rows as binary blocks, so a pass moves no lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = vectors_of(part.column(features))
                ids = np.asarray(part.column(row_id)).astype(np.int64).tobytes() if row_id else None
                yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([x.tobytes()], pa.binary()), pa.array([ids], pa.binary())], names=["n", "block", "ids"])

    return df.select(*([row_id] if row_id else []), features).mapInArrow(run, "n long, block binary, ids binary")


def distributed_pass(blocks: DataFrame, config: MapConfig, tasks: int) -> Callable[[np.ndarray], Sums]:
    """A pass over cached blocks."""
    spark = blocks.sparkSession

    def one_pass(w: np.ndarray) -> Sums:
        shared = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, got = shared.value, None
            for part in batches:
                for n, block in zip(part.column("n").to_pylist(), part.column("block").to_pylist(), strict=True):
                    x = np.frombuffer(block).reshape(n, -1)
                    check_features(x, w)
                    if len(x):
                        own = partial_sums(x, w, config)
                        got = own if got is None else tuple(a + b for a, b in zip(got, own, strict=True))
            if got is not None:
                yield sums_batch(got)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = None
            for part in batches:
                for row in part.to_pylist():
                    own = sums_of(row, w_shape)
                    got = own if got is None else tuple(a + b for a, b in zip(got, own, strict=True))
            if got is not None:
                yield sums_batch(got)

        w_shape = w.shape
        schema = "n binary, s binary, d double, e double"
        parts = blocks.mapInArrow(run, schema)
        if tasks > MANY_TASKS:  # add on executors first: the driver gets a few partial sums only
            parts = parts.repartition(max(2, int(tasks**0.5) // 4)).mapInArrow(add, schema)
        rows = [sums_of(r.asDict(), w_shape) for r in parts.collect()]
        shared.unpersist()
        if not rows:
            return np.zeros(len(w)), np.zeros_like(w), 0.0, 0.0
        return tuple(sum(v) for v in zip(*rows, strict=True))

    return one_pass


def sums_batch(s: Sums) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s[0].tobytes()], pa.binary()), pa.array([s[1].tobytes()], pa.binary()), pa.array([float(s[2])]), pa.array([float(s[3])])], names=["n", "s", "d", "e"])


def sums_of(row: dict, shape: tuple[int, int]) -> Sums:
    return np.frombuffer(bytes(row["n"])), np.frombuffer(bytes(row["s"])).reshape(shape), row["d"], row["e"]


def fit(df: DataFrame, config: MapConfig, weights: np.ndarray | None = None, init: str | None = None, features: str = "features", row_id: str = "row_id") -> tuple[np.ndarray, list[tuple[int, float, float]]]:
    """Trained (K, F) weights and the history (epoch, qe, te_pct).

    Starts from ``weights`` if given, else from ``init`` (or the configuration's mode).
    """
    rows = df.select(*([row_id] if row_id in df.columns else []), F.col(features).cast("array<double>").alias(features))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size(features)).alias("f")).first()
    if not size["n"]:
        raise ValueError("there are no rows to train on")
    if config.num_features is not None and size["f"] != config.num_features:
        raise ValueError(f"rows have {size['f']} features, the map has {config.num_features}")
    cells = size["n"] * size["f"]
    local = config.strategy == "local" or config.strategy == "auto" and cells <= LOCAL_CELLS
    w = weights.copy() if weights is not None else initial_weights(rows, config, init, features, row_id)
    batches = -(-size["n"] // config.batch_size) if config.batch_size else 1
    if batches > 1 and row_id not in df.columns:
        raise ValueError("mini-batches need a row id")
    if local:
        got = (rows.orderBy(row_id) if row_id in df.columns else rows).toArrow()
        x = vectors_of(got.column(features))
        check_features(x, w)
        if batches > 1:
            ids = got.column(row_id).to_numpy().astype(np.int64)
            return fit_batches(local_batches(x, ids, batches, config), w, config)
        return fit_passes(lambda w: partial_sums(x, w, config), w, config)
    blocks = packed(rows, features, row_id if batches > 1 else None).persist(StorageLevel.MEMORY_AND_DISK)
    tasks = blocks.rdd.getNumPartitions()
    try:
        if batches > 1:
            return fit_batches(distributed_batches(blocks, batches, config, tasks), w, config)
        return fit_passes(distributed_pass(blocks, config, tasks), w, config)
    finally:
        blocks.unpersist()
