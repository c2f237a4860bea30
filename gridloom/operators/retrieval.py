"""Just-in-time retrieval: historical rows for each query, tier by tier, for all queries at once.

Everything depends on a query's best unit alone, so tiers are found once for each distinct unit (at
most K) and joined to the queries.  Tier 1 is the unit's own rows, tier 2 those of its grid
neighbours, tier 3 (mode "bmu_neighborhood_knn", while ``threshold`` rows are not exceeded) whole
neurons by distance from the unit's weights until they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.distances import COLUMNS
from gridloom.operators.prepare import numbered

MODES = ("bmu_only", "bmu_neighborhood", "bmu_neighborhood_knn")


def unit_tiers(units: DataFrame, index: DataFrame, codebook: DataFrame, neighbors: DataFrame, mode: str, threshold: int, distance: str) -> DataFrame:
    """``bmu``, ``neuron_id``, ``tier``, ``place``: the neurons whose rows each unit collects.

    ``neighbors`` is wrapped and distinct on a torus.  All tables have K rows, or K x K at most.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}; got {mode!r}")
    filled = index.groupBy("neuron_id").agg(F.count("*").alias("n"))
    first = units.select("bmu", F.col("bmu").alias("neuron_id"), F.lit(1).alias("tier"), F.lit(0).alias("place")).join(filled, "neuron_id", "left_semi")
    tiers = first
    if mode != "bmu_only":
        near = units.join(neighbors, F.col("bmu") == F.col("neuron_id")).select("bmu", F.col("nbr_id").alias("neuron_id"), F.lit(2).alias("tier"), "place")
        tiers = tiers.unionByName(near.join(filled, "neuron_id", "left_semi"))
    if mode == "bmu_neighborhood_knn":
        got = units.join(tiers.join(filled, "neuron_id").groupBy("bmu").agg(F.sum("n").alias("got")), "bmu", "left").select("bmu", F.coalesce("got", F.lit(0)).alias("got")).filter(F.col("got") <= threshold)
        weights = codebook.select(F.col("neuron_id").alias("c_id"), F.col("w").alias("c_w"))
        base = got.join(weights.withColumnsRenamed({"c_id": "bmu", "c_w": "b_w"}), "bmu")
        free = base.crossJoin(F.broadcast(weights.join(filled, F.col("c_id") == F.col("neuron_id")).select("c_id", "c_w", "n"))).join(tiers.select(F.col("bmu").alias("t_bmu"), F.col("neuron_id").alias("t_id")), (F.col("bmu") == F.col("t_bmu")) & (F.col("c_id") == F.col("t_id")), "left_anti")
        d = free.select("bmu", "got", F.col("c_id").alias("neuron_id"), "n", COLUMNS[distance](F.col("b_w"), F.col("c_w")).alias("d"))
        order = Window.partitionBy("bmu").orderBy("d", "neuron_id")
        ahead = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        more = d.withColumns({"ahead": ahead, "place": F.row_number().over(order)}).filter(F.col("got") + F.col("ahead") <= threshold)
        tiers = tiers.unionByName(more.select("bmu", "neuron_id", F.lit(3).alias("tier"), "place"))
    return tiers


def collect_samples(queries: DataFrame, index: DataFrame, codebook: DataFrame, neighbors: DataFrame, mode: str = "bmu_neighborhood_knn", threshold: int = 50, distance: str = "euclidean", historical: DataFrame | None = None) -> DataFrame:
    """``query_id``, ``tier``, ``seq`` (from 1), ``row_id``, and the columns of ``historical`` by ``row_id``.

    ``queries``: ``query_id``, ``bmu``.  ``index``: ``neuron_id``, ``row_id``.  Rows are numbered by ranges of
    (neuron, row id) and get their place by adding where their neuron begins in a unit's tiers; tables of
    units and neurons (K x K rows at most) are broadcast.
    """
    units = queries.select("bmu").distinct()
    tiers = unit_tiers(units, index, codebook, neighbors, mode, threshold, distance).persist()
    rows = index.join(F.broadcast(tiers.select("neuron_id").distinct()), "neuron_id", "left_semi").select("neuron_id", "row_id")
    rows = numbered(rows, ["neuron_id", "row_id"])  # over all neurons, so that no neuron is one task
    first = rows.groupBy("neuron_id").agg(F.min("__n").alias("first"), F.count("*").alias("n"))
    order = Window.partitionBy("bmu").orderBy("tier", "place", "neuron_id")
    ahead = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = tiers.join(first, "neuron_id").select("bmu", "neuron_id", "tier", (ahead - F.col("first") + 1).alias("shift"))
    each = rows.join(F.broadcast(starts), "neuron_id").select("bmu", "tier", (F.col("__n") + F.col("shift")).alias("seq"), "row_id")
    found = queries.select("query_id", "bmu").join(each, "bmu").select("query_id", "tier", "seq", "row_id")
    return found if historical is None else found.join(historical, "row_id")


def local_mean(samples: DataFrame, output: str, by: str = "query_id") -> DataFrame:
    return samples.groupBy(by).agg(F.avg(output).alias("prediction"), F.count("*").alias("n"))


def local_line(samples: DataFrame, x: str, y: str, by: str = "query_id") -> DataFrame:
    """Least-squares line of each query's buffer, by sums that combine inside tasks."""
    return samples.groupBy(by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def local_ols(samples: DataFrame, features: str, output: str, ridge: float = 1e-8, by: str = "query_id") -> DataFrame:
    """Linear model with intercept of each query's buffer: ``coef`` (intercept first) and ``n``.

    A buffer is bounded by the retrieval threshold and one neuron's rows.
    """
    import numpy as np
    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack((np.ones(len(pdf)), np.stack(pdf[features].to_numpy())))
        coef = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ pdf[output].to_numpy(dtype=float))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [len(pdf)], "coef": [coef.tolist()]})

    kind = dict(samples.dtypes)[by]
    return samples.select(by, features, output).groupBy(by).applyInPandas(solve, f"{by} {kind}, n long, coef array<double>")
