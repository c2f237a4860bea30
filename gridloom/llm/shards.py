"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows of input partition p go to shard s is entry (p, s) of a matrix with fixed row and column
sums (shards differ by one row at most), drawn exactly: the partitions are halved again and again,
each half's share of every shard being multivariate hypergeometric.  Every node of that tree has its
own random stream, so a task derives its matrix row by walking from the root, in the logarithm of the
number of partitions; the driver holds partition sizes only.  A task then deals its counts to its
rows in random order (the local permutation) and gives every row a random key.  The leading bits of the
key name a cell of the shard, so the exchange spreads each shard over many tasks, and the order of
keys is the second permutation.  A cell's first slot is the number of keys in the cells before it:
keys follow from random streams alone, so cells are counted without reading a row.

Rows are never merged: repeats, nulls and ties are rows like any others; a very long text moves once; an
empty table gives no rows; columns named like the result's are replaced.  A task that runs again must
read the same rows in the same order: plain file scans do, anything else is first written to the
shared folder.  A task whose row count differs from the first pass raises an error.  The law is "rows".
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import common as C

CELL_ROWS = 1024


def split_counts(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows, drawn without replacement, are of each of the ``counts`` kinds.

    Exact for any size: each row joins with probability n/total, then the surplus leaves (or what is
    missing joins) uniformly, which is about the square root of the total.
    """
    total = int(counts.sum())
    if n <= 0 or n >= total:
        return counts.copy() if n > 0 else np.zeros_like(counts)
    got = rng.binomial(counts, n / total)
    extra = int(got.sum()) - n
    pool = got if extra > 0 else counts - got
    if extra:
        at = rng.choice(int(pool.sum()), abs(extra), replace=False, shuffle=False)
        moved = np.bincount(np.searchsorted(np.cumsum(pool), at, "right"), minlength=len(counts))
        got = got - moved if extra > 0 else got + moved
    return got


def even(n: int, parts: int) -> np.ndarray:
    """Sizes of ``parts`` runs of n rows that differ by one at most."""
    return np.full(parts, n // parts, np.int64) + (np.arange(parts) < n % parts)


def matrix_row(sizes: np.ndarray, cells: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row p of the communication matrix of partitions of ``sizes`` rows to shards of ``cells`` rows."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    low, high, share = 0, len(sizes), cells
    while high - low > 1:
        mid = (low + high) // 2
        left = split_counts(np.random.default_rng([seed, 0, low, high]), share, int(total[mid] - total[low]))
        if p < mid:
            high, share = mid, left
        else:
            low, share = mid, share - left
    return share


class Deal:
    """The random streams of partition p: the shard of each row, and its key."""

    def __init__(self, sizes: np.ndarray, shards: int, cell_bits: int, p: int, seed: int):
        self.rng, self.bits, self.at = np.random.default_rng([seed, 1, p]), cell_bits, 0
        counts = matrix_row(sizes, even(int(sizes.sum()), shards), p, seed)
        self.shard = np.repeat(np.arange(shards, dtype=np.int32), counts)
        self.rng.shuffle(self.shard)

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next rows' shards, cells (numbered over all shards) and keys."""
        shard = self.shard[self.at : self.at + n].astype(np.int64)
        self.at += n
        key = self.rng.integers(0, 1 << 63, n, dtype=np.int64)
        return shard, shard << self.bits | key >> (63 - self.bits), key


def rows_in_order(df: DataFrame) -> DataFrame:
    """``df`` if it is a plain scan of files, which reads the same rows in the same order every time; else a
    copy of it in the shared folder."""
    nodes = set(re.findall(r"(?m)^[\s:+*()\d-]*([A-Z]\w*)", df._jdf.queryExecution().executedPlan().toString()))
    plain = "FileScan" in nodes and nodes <= {"Project", "Filter", "ColumnarToRow", "FileScan"}
    return df if plain else C.materialise(df)


def count_cells(spark: SparkSession, sizes: np.ndarray, shared, shards: int, cell_bits: int, seed: int) -> DataFrame:
    """``__cell`` and ``__first``, the slot of its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                deal, left = Deal(shared.value, shards, cell_bits, p, seed), int(shared.value[p])
                while left:
                    n = min(left, 1 << 16)
                    left -= n
                    cell, count = np.unique(deal.take(n)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(count)], names=["__cell", "n"])

    counted = C.map_arrow(spark.range(0, len(sizes), 1, max(1, min(len(sizes), 200))), run, "__cell long, n long")
    by_cell = counted.groupBy("__cell").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(F.shiftright("__cell", cell_bits)).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    return by_cell.select("__cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))


def shuffle_to_shards(df: DataFrame, shards: int, seed: int = 0, cell_rows: int = CELL_ROWS, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` and ``slot`` (replacing columns of these names)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rest = rows_in_order(df.drop(shard, slot))
    counted = rest.groupBy(F.spark_partition_id().alias("p")).count().collect()  # one small row for each task
    sizes = np.zeros(max((r["p"] for r in counted), default=-1) + 1, np.int64)
    for r in counted:
        sizes[r["p"]] = r["count"]
    bits = max(0, (int(sizes.sum()) // (shards * cell_rows)).bit_length())
    shared = rest.sparkSession.sparkContext.broadcast(sizes)
    own = [T.StructField(f"__{k}", T.LongType()) for k in ("shard", "cell", "key")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, sizes = TaskContext.get().partitionId(), shared.value
        have, at = int(sizes[p]) if p < len(sizes) else 0, 0
        deal = Deal(sizes, shards, bits, p, seed) if have else None
        for batch in batches:
            at += batch.num_rows
            if at > have:
                break
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, deal.take(batch.num_rows))], names=[*batch.schema.names, *(f.name for f in own)])
        if at != have:
            raise RuntimeError(f"partition {p} had {have} rows when it was counted, and now another number")

    placed = C.map_arrow(rest, run, T.StructType([*rest.schema.fields, *own]))
    order = Window.partitionBy("__cell").orderBy("__key")
    ranked = placed.withColumn("__rank", F.row_number().over(order) - 1).join(count_cells(rest.sparkSession, sizes, shared, shards, bits, seed), "__cell")
    return ranked.select(*rest.columns, F.col("__shard").cast("int").alias(shard), (F.col("__first") + F.col("__rank")).alias(slot))
