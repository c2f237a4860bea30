"""Streams of feature rows over a trained map: assignment, windowed drift, and codebook swaps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gridloom.operators.bmu import assign


def assign_stream(rows: DataFrame, weights: np.ndarray, distance: str = "euclidean", features: str = "features") -> DataFrame:
    """Nearest neurons of a (streaming) DataFrame: stateless, the codebook travels to the rows."""
    return assign(rows, weights, distance, features, "arrow", True)


def timed(assigned: DataFrame, time: str, late: str) -> DataFrame:
    """Event time with a watermark on streams, which need a timestamp with a zone."""
    return assigned.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if assigned.isStreaming else assigned


def drift_by_window(assigned: DataFrame, time: str = "ts", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """``start``, ``n``, ``qe`` of each event-time window; rows later than the watermark are dropped."""
    own = timed(assigned, time, late)
    return own.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.avg("d1").alias("qe")).select(F.col("w.start").alias("start"), "n", "qe")


def hits_by_window(assigned: DataFrame, time: str = "ts", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """``start``, ``nid``, ``n``: hits of each neuron by event-time window."""
    own = timed(assigned, time, late)
    return own.groupBy(F.window(time, window).alias("w"), F.col("nid1").alias("nid")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "nid", "n")


def write_assigned(rows: DataFrame, current: Callable[[], np.ndarray], path: str, checkpoint: str, distance: str = "euclidean", features: str = "features") -> DataStreamWriter:
    """Each micro-batch is assigned with the codebook of that moment and appended as Parquet.

    ``current`` gives the weights when a batch starts, so a retrained map takes over between batches.
    A batch that is run again overwrites its own folder, so the sink holds every row once.
    """

    def sink(batch: DataFrame, number: int) -> None:
        assign(batch, current(), distance, features, "arrow", True).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


def running_units(rows: DataFrame, weights: np.ndarray, key: str, features: str = "features") -> DataFrame:
    """The last neuron and number of moves between neurons of each key, kept as state across batches.

    For batch input it is the same fold over all rows of a key.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    got = assign(rows, weights, "euclidean", features, "arrow", False).select(key, "nid1")
    kind = dict(got.dtypes)[key]

    def step(own: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        last, moves = state.get if state.exists else (-1, 0)
        for pdf in frames:
            for nid in pdf["nid1"]:
                moves += int(last >= 0 and nid != last)
                last = int(nid)
        state.update((last, moves))
        yield pd.DataFrame({key: [own[0]], "nid": [last], "moves": [moves]})

    return got.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, nid int, moves int", "nid int, moves int", "update", GroupStateTimeout.NoTimeout)


