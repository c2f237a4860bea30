"""Best matching units: each row against a codebook, by an Arrow kernel or by SQL.

The codebook is a map's size (its bytes are checked) and travels to the rows; rows never move.  The
Arrow path multiplies blocks of rows with the weights and is the default; the SQL path is a broadcast
nested-loop join with a min over structs, for small maps and as a cross-check.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.distances import COLUMNS, nearest
from gridloom.operators.search import SearchStrategy
from gridloom.sources.tables import codebook_array

BLOCK_BYTES = 32 << 20
CODEBOOK_BYTES = 256 << 20


def vectors_of(column: pa.Array) -> np.ndarray:
    """A list column as (B, F) doubles; all rows must have one length and no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if column.null_count or len(flat) % len(column):
        raise ValueError("feature vectors must be non-null and of one length")
    return flat.reshape(len(column), -1)


def check_features(x: np.ndarray, w: np.ndarray) -> None:
    if len(x) and x.shape[1] != w.shape[1]:
        raise ValueError(f"rows have {x.shape[1]} features, the map has {w.shape[1]}")


def row_blocks(x: np.ndarray, neurons: int) -> Iterator[np.ndarray]:
    step = max(1, BLOCK_BYTES // (8 * max(neurons, 1)))
    for i in range(0, len(x), step):
        yield x[i : i + step]


def top_units(df: DataFrame, weights: np.ndarray, distance: str | Callable | SearchStrategy = "euclidean", k: int = 2, features: str = "features") -> DataFrame:
    """``df`` without its features, with ``units`` and ``dists``: the k nearest neurons in order (Arrow).

    A codebook of over ``CODEBOOK_BYTES`` travels in parts, each of which goes on from the k best so far.  A
    search strategy takes the place of a distance; it is rebuilt once, on the driver.
    """
    step = max(1, CODEBOOK_BYTES // max(1, weights.nbytes // max(1, len(weights))))
    got = df.drop("units", "dists")
    for first in range(0, len(weights), step):
        got = _top_units(got, weights[first : first + step], first, distance, k, features)
    return got.drop(features)


def _top_units(df: DataFrame, weights: np.ndarray, first: int, distance: str | Callable | SearchStrategy, k: int, features: str) -> DataFrame:
    """``top_units`` of some of the neurons, merged with those in ``units`` and ``dists``; features stay."""
    neurons, width = weights.shape
    if isinstance(distance, SearchStrategy):
        distance.rebuild(weights)
    shared = df.sparkSession.sparkContext.broadcast(distance if isinstance(distance, SearchStrategy) else weights)
    passed = [f for f in df.schema.fields if f.name not in ("units", "dists")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors_of(batch.column(features))
            if len(x) and x.shape[1] != width:
                raise ValueError(f"rows have {x.shape[1]} features, the map has {width}")
            found = [w.search(part, k) if isinstance(w, SearchStrategy) else nearest(part, w, distance, k) for part in row_blocks(x, neurons)]
            ids, d = np.concatenate([f[0] for f in found]) + first, np.concatenate([f[1] for f in found])
            if first:  # equal distances go to the lower ids, which came before
                ids = np.concatenate((batch.column("units").flatten().to_numpy().reshape(len(x), -1), ids), axis=1)
                d = np.concatenate((batch.column("dists").flatten().to_numpy().reshape(len(x), -1), d), axis=1)
                best = np.argsort(d, axis=1, kind="stable")[:, :k]
                ids, d = np.take_along_axis(ids, best, axis=1), np.take_along_axis(d, best, axis=1)
            step = pa.array(np.arange(0, ids.size + 1, ids.shape[1], dtype=np.int32))
            own = [pa.ListArray.from_arrays(step, pa.array(ids.astype(np.int32).ravel())), pa.ListArray.from_arrays(step, pa.array(d.ravel()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in passed), *own], names=[*(f.name for f in passed), "units", "dists"])

    schema = T.StructType([*passed, T.StructField("units", T.ArrayType(T.IntegerType())), T.StructField("dists", T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(run, schema)


def assign(df: DataFrame, codebook: DataFrame | np.ndarray, distance: str | Callable | SearchStrategy = "euclidean", features: str = "features", strategy: str = "auto", second: bool = True, row_id: str | list[str] = "row_id") -> DataFrame:
    """``df`` without its features, with ``nid1``, ``d1`` (and ``nid2``, ``d2``): the nearest neurons.

    Ties go to the lowest id.  ``strategy``: "arrow" (also meant by "auto", whatever the map's size), or
    "sql", which needs the codebook as a table and a ``row_id`` that tells rows apart.
    """
    if strategy == "sql":
        return assign_sql(df, codebook, distance, features, second, row_id)
    weights = codebook_array(codebook) if isinstance(codebook, DataFrame) else codebook
    got = top_units(df, weights, distance, 2 if second else 1, features)
    out = {"nid1": F.col("units")[0], "d1": F.col("dists")[0]}
    if second:
        out |= {"nid2": F.get("units", F.lit(1)), "d2": F.get("dists", F.lit(1))}
    return got.withColumns(out).drop("units", "dists")


def assign_sql(df: DataFrame, codebook: DataFrame, distance: str, features: str = "features", second: bool = True, row_id: str | list[str] = "row_id") -> DataFrame:
    """``assign`` by a broadcast nested-loop join and one grouped min of (distance, neuron) structs."""
    ids = [row_id] if isinstance(row_id, str) else row_id
    rest = [c for c in df.columns if c not in (features, *ids)]
    pairs = df.crossJoin(F.broadcast(codebook.select("neuron_id", F.col("w").alias("__w"))))
    unit = F.struct(COLUMNS[distance](F.col(features).cast("array<double>"), F.col("__w")).alias("d"), F.col("neuron_id").cast("int").alias("nid"))
    near = pairs.select(*ids, *rest, unit.alias("u")).groupBy(*ids).agg(*[F.first(c).alias(c) for c in rest], (F.slice(F.array_sort(F.collect_list("u")), 1, 2) if second else F.array(F.min("u"))).alias("u"))
    out = {"nid1": F.col("u")[0]["nid"], "d1": F.col("u")[0]["d"]}
    if second:
        out |= {"nid2": F.get("u", F.lit(1))["nid"], "d2": F.get("u", F.lit(1))["d"]}
    return near.withColumns(out).select(*[c for c in df.columns if c != features], *out)


def top_k_rows(df: DataFrame, codebook: DataFrame | np.ndarray, k: int, distance: str | Callable | SearchStrategy = "euclidean", features: str = "features", row_id: str = "row_id") -> DataFrame:
    """``row_id``, ``rank`` (from 1), ``neuron_id``, ``d`` of the k nearest neurons; rows are not shuffled."""
    weights = codebook_array(codebook) if isinstance(codebook, DataFrame) else codebook
    got = top_units(df.select(row_id, features), weights, distance, k, features)
    each = got.select(row_id, "dists", F.posexplode("units").alias("at", "neuron_id"))
    return each.select(row_id, (F.col("at") + 1).alias("rank"), "neuron_id", F.expr("dists[at]").alias("d"))
