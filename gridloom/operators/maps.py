"""Map tables over assigned rows: one grouped aggregation each, joined to the K neurons.

Inputs are ``bmus`` (``nid1`` and what is carried along) and ``neurons`` (``neuron_id``, ``row``,
``col``).  A map is ``row``, ``col``, ``value``; neurons without rows have a null value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.distances import COLUMNS

#: What a single row's deviation and score count as.
FLOOR = 1e-8


def on_grid(neurons: DataFrame, values: DataFrame, value: Column | str = "value") -> DataFrame:
    column = F.col(value) if isinstance(value, str) else value
    return neurons.join(values, neurons["neuron_id"] == values["nid"], "left").select("row", "col", column.alias("value"))


def hit_map(neurons: DataFrame, bmus: DataFrame) -> DataFrame:
    """Rows by neuron, zero where there are none."""
    hits = bmus.groupBy(F.col("nid1").alias("nid")).agg(F.count("*").alias("value"))
    return on_grid(neurons, hits, F.coalesce("value", F.lit(0)))


def bmu_index(bmus: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``neuron_id``, ``row_id``: the index of rows by neuron, a narrow table that joins use."""
    return bmus.select(F.col("nid1").alias("neuron_id"), F.col(row_id).alias("row_id"))


def bmus_data_map(bmus: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``neuron_id``, ``row_ids`` in order: the index for display; joins use ``bmu_index``."""
    return bmus.groupBy(F.col("nid1").alias("neuron_id")).agg(F.array_sort(F.collect_list(row_id)).alias("row_ids"))


def _by_neuron(bmus: DataFrame, target: str) -> DataFrame:
    return bmus.groupBy(F.col("nid1").alias("nid")).agg(F.count("*").alias("n"), F.avg(target).alias("mean"), F.stddev_samp(F.col(target).cast("double")).alias("sd"))


def deviation() -> Column:
    return F.when(F.col("n") > 1, F.col("sd")).otherwise(FLOOR)


def metric_map(neurons: DataFrame, bmus: DataFrame, target: str, reduction: str) -> DataFrame:
    """Mean or sample deviation of the target by neuron; one row alone deviates by ``FLOOR``."""
    if reduction not in ("mean", "std"):
        raise ValueError("reduction must be 'mean' or 'std'")
    return on_grid(neurons, _by_neuron(bmus, target), F.col("mean") if reduction == "mean" else deviation())


def score_map(neurons: DataFrame, bmus: DataFrame, target: str, total: int | None = None) -> DataFrame:
    """Standard error times log of the inverse share of rows, at least ``FLOOR``; lower is better."""
    stats = _by_neuron(bmus, target)
    stats = stats.withColumn("all", F.sum("n").over(Window.partitionBy()) if total is None else F.lit(total))  # over K rows
    score = F.greatest(deviation() / F.sqrt("n") * F.log(F.col("all") / F.col("n")), F.lit(FLOOR))
    return on_grid(neurons, stats, F.when(F.col("n") > 1, score).when(F.col("n") == 1, F.lit(FLOOR)))


def rank_map(neurons: DataFrame, bmus: DataFrame, target: str) -> DataFrame:
    """Rank by deviation, 1 being the largest; ties by neuron id.  There are at most K rows to rank."""
    order = Window.orderBy(F.desc("s"), "nid")
    ranked = _by_neuron(bmus, target).select("nid", deviation().alias("s")).withColumn("value", F.row_number().over(order))
    return on_grid(neurons, ranked)


def classification_map(neurons: DataFrame, bmus: DataFrame, label: str, neighbors: DataFrame) -> DataFrame:
    """The majority label; ties go to the most frequent label among neighbours' rows, then to the smallest.

    All labels of the neighbours count, also ones that the neuron itself lacks.
    """
    counts = bmus.groupBy(F.col("nid1").alias("nid"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    best = counts.groupBy("nid").agg(F.max("n").alias("most")).withColumnRenamed("nid", "b_nid")
    top = counts.join(best, (F.col("nid") == F.col("b_nid")) & (F.col("n") == F.col("most"))).groupBy("nid").agg(F.min("label").alias("label"), F.count("*").alias("ties"))
    around = neighbors.join(counts.withColumnRenamed("nid", "o_nid"), F.col("nbr_id") == F.col("o_nid")).groupBy(F.col("neuron_id").alias("a_nid"), "label").agg(F.sum("n").alias("n"))
    vote = around.groupBy("a_nid").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("v"))
    chosen = top.join(vote, F.col("nid") == F.col("a_nid"), "left").select("nid", F.when(F.col("ties") > 1, F.coalesce(F.col("v.label"), F.col("label"))).otherwise(F.col("label")).alias("value"))
    return on_grid(neurons, chosen)


def distance_map(codebook: DataFrame, neighbors: DataFrame, distance: str = "euclidean", scaling: str = "sum") -> DataFrame:
    """Sum or mean of weight distances to grid neighbours, over the map's maximum (if that is not 0)."""
    if scaling not in ("sum", "mean"):
        raise ValueError("scaling must be 'sum' or 'mean'")
    other = codebook.select(F.col("neuron_id").alias("o"), F.col("w").alias("ow"))
    pairs = neighbors.join(codebook, "neuron_id").join(other, F.col("nbr_id") == F.col("o"))
    each = pairs.select(F.col("neuron_id").alias("nid"), COLUMNS[distance](F.col("w"), F.col("ow")).alias("d"))
    fold = F.sum("d") if scaling == "sum" else F.avg("d")
    own = codebook.join(each.groupBy("nid").agg(fold.alias("v")), F.col("neuron_id") == F.col("nid"), "left").select("row", "col", F.coalesce("v", F.lit(0.0)).alias("v"))
    most = F.max("v").over(Window.partitionBy())
    return own.select("row", "col", F.when(most > 0, F.col("v") / most).otherwise(F.col("v")).alias("value"))


def component_planes(codebook: DataFrame) -> DataFrame:
    """``feature``, ``row``, ``col``, ``value`` of every weight."""
    return codebook.select("row", "col", F.posexplode("w").alias("feature", "value")).select("feature", "row", "col", "value")
