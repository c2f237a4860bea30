"""Feature preparation: vectors from columns, standardisation, encoding, splitting, filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vectorize(df: DataFrame, columns: list[str], out: str = "features", keep: list[str] | None = None) -> DataFrame:
    """Numeric columns as one array of doubles; ``keep`` names the columns that stay."""
    kept = [c for c in df.columns if c not in columns] if keep is None else keep
    return df.select(*kept, F.array(*[F.col(c).cast("double") for c in columns]).alias(out))


def standardize(df: DataFrame, columns: list[str], sample: bool = False) -> DataFrame:
    """z-scores by population or sample deviation; a constant column is only centred.

    One pass for a single row of statistics, which is broadcast to the scan.
    """
    spread = F.stddev_samp if sample else F.stddev_pop
    stats = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[spread(c).alias(f"__s_{c}") for c in columns])
    z = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.coalesce(F.col(f"__s_{c}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(z).select(*df.columns)


MANY_TASKS = 64


def folded(parts: DataFrame, fold, schema: str) -> DataFrame:
    """Partial results of many tasks, folded on executors first: the driver gets a few of them only."""
    tasks = parts.rdd.getNumPartitions()
    return parts if tasks <= MANY_TASKS else parts.repartition(max(2, int(tasks**0.5) // 4)).mapInArrow(fold, schema)


def vector_moments(df: DataFrame, vector: str = "features") -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, and mean and sum of squared deviations of each component: one small row for each task."""

    def merged(a: tuple | None, b: tuple) -> tuple:
        if a is None:
            return b
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + gap * gap * (a[0] * b[0] / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = None
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
                x = flat.reshape(batch.num_rows, -1)
                mean = x.mean(axis=0)
                got = merged(got, (len(x), mean, ((x - mean) ** 2).sum(axis=0)))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([got[0]]), pa.array([got[1].tobytes()], pa.binary()), pa.array([got[2].tobytes()], pa.binary())], names=["n", "mean", "m2"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = None
        for batch in batches:
            for r in batch.to_pylist():
                got = merged(got, (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["m2"])))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([got[0]]), pa.array([got[1].tobytes()], pa.binary()), pa.array([got[2].tobytes()], pa.binary())], names=["n", "mean", "m2"])

    total, schema = None, "n long, mean binary, m2 binary"
    parts = df.select(F.col(vector).cast("array<double>").alias(vector)).mapInArrow(run, schema)
    for r in folded(parts, fold, schema).collect():
        total = merged(total, (r["n"], np.frombuffer(bytes(r["mean"])), np.frombuffer(bytes(r["m2"]))))
    return total or (0, np.zeros(0), np.zeros(0))


def standardize_vectors(df: DataFrame, vector: str = "features", sample: bool = False) -> DataFrame:
    """z-scores of each component of an array column; a constant component is only centred."""
    n, mean, m2 = vector_moments(df, vector)
    spread = np.sqrt(m2 / max(1, n - sample)) if n else m2
    values = lambda v: F.array(*[F.lit(float(x)) for x in v])
    centred = F.zip_with(F.col(vector).cast("array<double>"), values(mean), lambda a, b: a - b)
    return df.withColumn(vector, F.zip_with(centred, values(np.where(spread == 0, 1.0, spread)), lambda a, b: a / b)) if n else df


BROADCAST_VALUES = 1_000_000


def encode_labels(df: DataFrame, column: str, out: str = "label") -> DataFrame:
    """Numbers from 1 in order of the distinct values; nulls stay null.

    Up to ``BROADCAST_VALUES`` values are numbered by one window and broadcast; more are sorted by ranges,
    numbered by their place in a range after the ranges before it, and joined by a shuffle.
    """
    known = df.select(F.col(column).alias("__value")).filter(F.col("__value").isNotNull()).distinct()
    if known.count() <= BROADCAST_VALUES:
        codes = F.broadcast(known.select("__value", F.row_number().over(Window.orderBy("__value")).alias(out)))
    else:
        codes = numbered(known, ["__value"]).withColumn("__n", F.col("__n").cast("int")).withColumnRenamed("__n", out)
    return df.join(codes, df[column] == codes["__value"], "left").drop("__value")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``__n``, each row's number from 1 in an order, without one task that sees all rows.

    The ranges are cached, as both uses of them must see the same ones.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).persist()
    part = F.shiftright("__at", 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))  # one row for each task
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    joined = ranged.withColumn("__part", part).join(F.broadcast(before), "__part")
    return joined.withColumn("__n", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__at", "__part", "__before")


def split_order(row_id: Column, seed: int = 0) -> Column:
    """A deterministic shuffle key that other engines can compute too."""
    return ((row_id + seed) * F.lit(2654435761)) % 1000003


def train_test_split(df: DataFrame, row_id: str = "row_id", share: float = 0.8, seed: int = 0) -> DataFrame:
    """``df`` with ``is_train``: the first floor(share * N) rows in shuffled order.

    The cut is found from counts by key and, among rows of the cut's key, by one row id; rows are not
    ranked.  Rows of one id stay on one side, also where that makes the share a little larger.
    """
    key = split_order(F.col(row_id), seed)
    counts = df.groupBy(key.alias("__k")).agg(F.count("*").alias("c"))  # 1,000,003 keys at most
    running = counts.select("__k", "c", F.sum("c").over(Window.orderBy("__k")).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("n"))
    cut = running.filter(F.col("upto") > F.floor(F.col("n") * share)).orderBy("__k").first()
    if cut is None:
        return df.withColumn("is_train", F.lit(True))
    room = int(share * cut["n"]) - (cut["upto"] - cut["c"])
    last = df.filter(key == cut["__k"]).orderBy(row_id).limit(room).agg(F.max(row_id)).first()[0] if room else None
    return df.withColumn("is_train", (key < cut["__k"]) | ((key == cut["__k"]) & (F.col(row_id) <= last) if room else F.lit(False)))


def drop_nan_rows(df: DataFrame, vector: str = "features") -> DataFrame:
    return df.filter(F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, lambda v: v.isNull() | F.isnan(v)), F.lit(True)))


def drop_noise(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(F.col(label) != -1)


def grid_cell(neuron: Column, y: int) -> tuple[Column, Column]:
    """Row and column of a flat neuron id."""
    return F.floor(neuron / y).cast("int"), (neuron % y).cast("int")


BATCH_PRIME = (1 << 31) - 1


def shuffle_key(row_id, epoch: int, seed: int = 0):
    """A shuffled order of ids for an epoch, of a Column or an array, that other engines can compute too:
    a permutation of the residues by a power of a generator of the prime field."""
    return ((row_id % BATCH_PRIME) + 1) * pow(48271, epoch + seed + 1, BATCH_PRIME) % BATCH_PRIME


def batch_number(row_id, batches: int, epoch: int, seed: int = 0):
    """Which of an epoch's batches a row is in, by its id: the one rule of mini-batches everywhere.

    No global ranking is needed, batches are of about one size, and rows of one id stay together.
    """
    return shuffle_key(row_id, epoch, seed) % batches


def shuffled_batches(df: DataFrame, batch_size: int, epoch: int, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """``df`` with ``batch``: batches of about ``batch_size`` rows in an order of their own each epoch."""
    n = max(1, -(-df.count() // batch_size))
    return df.withColumn("batch", batch_number(F.col(row_id).cast("long"), n, epoch, seed).cast("int"))
