"""Scans, synthetic sources, model files and result sinks."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.config import MapConfig
from gridloom.session import ship


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A CSV file with a header; give a schema to spare the inference pass."""
    reader = ship(spark).read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def blobs(spark: SparkSession, n: int, features: int, centers: int = 3, std: float = 1.0, box: float = 10.0, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """``row_id``, ``features``, ``label`` (from 1): isotropic Gaussian blobs around random centres."""
    middle = np.random.default_rng(seed).uniform(-box, box, (centers, features))
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    label = (F.col("id") % centers).cast("int")
    places = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in middle])
    noise = F.array(*[F.randn(seed + 1 + f) * std for f in range(features)])
    return rows.select(F.col("id").alias("row_id"), label.alias("label"), noise.alias("noise")).select("row_id", F.zip_with("noise", places[F.col("label")], lambda a, b: a + b).alias("features"), (F.col("label") + 1).alias("label"))


def codebook_table(spark: SparkSession, weights: np.ndarray, y: int) -> DataFrame:
    """``neuron_id``, ``row``, ``col``, ``w`` of a (K, F) codebook."""
    rows = [(i, i // y, i % y, [float(v) for v in w]) for i, w in enumerate(weights)]
    return spark.createDataFrame(rows, "neuron_id int, row int, col int, w array<double>")


def codebook_array(codebook: DataFrame) -> np.ndarray:
    """(K, F) weights of a codebook table; K is a map's size."""
    rows = sorted(codebook.select("neuron_id", "w").collect())
    return np.array([r[1] for r in rows], dtype=float)


def save_model(spark: SparkSession, path: str, config: MapConfig, weights: np.ndarray, history: list[tuple[int, float, float]] = ()) -> None:
    """Codebook as Parquet, configuration and training history as JSON, all by Spark's writers."""
    codebook_table(spark, weights, config.y).coalesce(1).write.mode("overwrite").parquet(f"{path}/codebook")
    spark.createDataFrame([(config.to_json(), json.dumps([list(h) for h in history]))], "config string, history string").coalesce(1).write.mode("overwrite").json(f"{path}/config")


def load_model(spark: SparkSession, path: str) -> tuple[MapConfig, np.ndarray, list[tuple[int, float, float]]]:
    row = spark.read.schema("config string, history string").json(f"{path}/config").first()
    return MapConfig.from_json(row["config"]), codebook_array(spark.read.parquet(f"{path}/codebook")), [tuple(h) for h in json.loads(row["history"])]


def append_results(df: DataFrame, path: str) -> None:
    """Append result documents as JSON lines."""
    df.write.mode("append").json(path)


def write_map(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def feature_array(*columns: str) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])
