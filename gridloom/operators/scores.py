"""Clustering scores of labelled points (``id``, ``label``, ``features``), as grouped aggregations.

Points are a map's neurons, so pairs of points are K x K rows.  Noise (label -1) is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.distances import euclidean
from gridloom.functions.lattice import offset_distance


def silhouette_samples(points: DataFrame) -> DataFrame:
    """``id``, ``label``, ``s``: (b - a) / max(a, b) for each point; 0 in a cluster of one."""
    own = points.filter("label <> -1").select("id", "label", "features")
    other = own.select(F.col("id").alias("o_id"), F.col("label").alias("o_label"), F.col("features").alias("o_f"))
    mean = own.crossJoin(F.broadcast(other)).filter("id <> o_id").groupBy("id", "label", "o_label").agg(F.avg(euclidean(F.col("features"), F.col("o_f"))).alias("d"))
    near = mean.groupBy("id", "label").agg(F.max(F.when(F.col("o_label") == F.col("label"), F.col("d"))).alias("a"), F.min(F.when(F.col("o_label") != F.col("label"), F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return near.select("id", "label", s.alias("s"))


def silhouette(points: DataFrame) -> DataFrame:
    """``silhouette``: the mean; 0 with fewer than two clusters."""
    own = points.filter("label <> -1")
    k = own.agg(F.count_distinct("label").alias("k"))
    return silhouette_samples(points).agg(F.avg("s").alias("m")).crossJoin(k).select(F.when(F.col("k") > 1, F.coalesce("m", F.lit(0.0))).otherwise(0.0).alias("silhouette"))


def centers(points: DataFrame) -> DataFrame:
    """``label``, ``n``, ``center`` without noise."""
    flat = points.filter("label <> -1").select("label", "id", F.posexplode("features").alias("f", "v"))
    by_feature = flat.groupBy("label", "f").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    return by_feature.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("f", "v"))), lambda s: s["v"]).alias("center"))


def davies_bouldin(points: DataFrame) -> DataFrame:
    """``davies_bouldin``: 0 with one cluster, infinite where all is noise."""
    mid = centers(points)
    spread = points.filter("label <> -1").join(F.broadcast(mid), "label").groupBy("label", "center").agg(F.avg(euclidean(F.col("features"), F.col("center"))).alias("s"))
    other = spread.select(F.col("label").alias("l2"), F.col("center").alias("c2"), F.col("s").alias("s2"))
    d = euclidean(F.col("center"), F.col("c2"))
    worst = spread.join(F.broadcast(other), F.col("label") != F.col("l2")).groupBy("label").agg(F.max(F.when(d > 0, (F.col("s") + F.col("s2")) / d).otherwise(0.0)).alias("r"))
    k = points.agg(F.count_distinct(F.when(F.col("label") != -1, F.col("label"))).alias("k"))
    return worst.agg(F.avg("r").alias("m")).crossJoin(k).select(F.when(F.col("k") == 0, F.lit(float("inf"))).when(F.col("k") == 1, 0.0).otherwise(F.col("m")).alias("davies_bouldin"))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """``calinski_harabasz``: between over within variance; 0 where it is not defined."""
    flat = points.filter("label <> -1").select("label", "id", F.posexplode("features").alias("f", "v"))
    by_label = flat.groupBy("label", "f").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("var"))
    whole = flat.groupBy("f").agg(F.avg("v").alias("mean"))
    sums = by_label.join(F.broadcast(whole), "f").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("b"), F.sum(F.col("n") * F.col("var")).alias("w"), F.count_distinct("label").alias("k"))
    n = points.filter("label <> -1").agg(F.count("*").alias("total"))
    score = (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("total") - F.col("k")))
    return sums.crossJoin(n).select(F.when((F.col("k") > 1) & (F.col("total") > F.col("k")) & (F.col("w") > 0), score).otherwise(0.0).alias("calinski_harabasz"))


def topological_quality(labels: DataFrame, x: int, y: int, topology: str = "rectangular") -> DataFrame:
    """``topological_quality`` of ``row``, ``col``, ``label``: how compact clusters lie on the grid.

    Clusters of two neurons or more count by size with 1 / (1 + mean grid distance / max(x, y)).
    """
    own = labels.filter("label <> -1").select("row", "col", "label")
    other = own.select(F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("label").alias("l2"))
    pairs = own.join(other, (F.col("label") == F.col("l2")) & ((F.col("row") != F.col("r2")) | (F.col("col") != F.col("c2"))))
    d = offset_distance(F.col("row"), F.col("col"), F.col("r2"), F.col("c2")) if topology == "hexagonal" else F.sqrt(F.pow(F.col("row") - F.col("r2"), 2) + F.pow(F.col("col") - F.col("c2"), 2))
    by_label = pairs.groupBy("label").agg(F.avg(d).alias("d"), F.count_distinct("row", "col").alias("n"))
    k = own.agg(F.count_distinct("label").alias("k"))
    q = F.sum(F.col("n") / (1 + F.col("d") / max(x, y))) / F.sum("n")
    return by_label.agg(q.alias("q")).crossJoin(k).select(F.when(F.col("k") <= 1, 1.0).otherwise(F.coalesce("q", F.lit(1.0))).alias("topological_quality"))


def cluster_counts(points: DataFrame) -> DataFrame:
    """``n_clusters``, ``n_noise_points``, ``noise_ratio``."""
    noise = F.count_if(F.col("label") == -1)
    return points.agg(F.count_distinct(F.when(F.col("label") != -1, F.col("label"))).alias("n_clusters"), noise.alias("n_noise_points"), (noise / F.count("*")).alias("noise_ratio"))


def all_scores(points: DataFrame, x: int | None = None, y: int | None = None, topology: str = "rectangular") -> DataFrame:
    """Every score in one row; the grid's score needs ``row`` and ``col`` and the map's size."""
    out = silhouette(points).crossJoin(davies_bouldin(points)).crossJoin(calinski_harabasz(points)).crossJoin(cluster_counts(points))
    return out.crossJoin(topological_quality(points, x, y, topology)) if x and y else out
