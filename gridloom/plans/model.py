"""``FeatureMap``: the model facade over the operators.

It holds a configuration, (K, F) weights and small tables of K rows; data stay DataFrames with a
``features`` array, a ``row_id`` where rows must be told apart, and any target columns.
"""

from __future__ import annotations

import json
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.config import MapConfig
from gridloom.functions import lattice
from gridloom.functions.distances import nearest
from gridloom.operators import bmu, clustering, codebook, maps, quality, retrieval, scores, training
from gridloom.plans.base import MapModel
from gridloom.session import ship
from gridloom.sources import render, tables

MAP_TYPES = ("hit", "distance", "bmus_data", "metric", "score", "rank", "classification")
NEEDS_DATA = ("hit", "bmus_data")
NEEDS_TARGET = ("metric", "score", "rank", "classification")


class FeatureMap(MapModel):
    def __init__(self, spark: SparkSession, config: MapConfig, weights: np.ndarray | None = None, features: str = "features", row_id: str = "row_id"):
        self.spark, self.config, self.features, self.row_id = ship(spark), config, features, row_id
        self.weights = weights if weights is not None else codebook.unit_vectors(config, config.num_features) if config.num_features else None
        self.history: list[tuple[int, float, float]] = []
        self._cached: list[DataFrame] = []

    # ---- training

    def initialize(self, df: DataFrame, mode: str | None = None) -> FeatureMap:
        self.weights = codebook.initial_weights(df.withColumn(self.features, F.col(self.features).cast("array<double>")), self.config, mode, self.features, self.row_id)
        return self

    def fit(self, df: DataFrame, init: str | None = None) -> FeatureMap:
        """Train; ``init`` starts anew by that mode, otherwise training goes on from the weights."""
        start = None if init else self.weights
        self.weights, self.history = training.fit(df, self.config, start, init, self.features, self.row_id)
        return self

    def history_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.history, "epoch int, qe double, te_pct double")

    # ---- small tables

    def codebook(self) -> DataFrame:
        return tables.codebook_table(self.spark, self.weights, self.config.y)

    def neurons(self) -> DataFrame:
        c = self.config
        return lattice.neuron_table(self.spark, c.x, c.y, c.topology, c.hex_geometry)

    def neighbors(self, order: int | None = None, wrap: bool = False) -> DataFrame:
        c = self.config
        return lattice.neighbor_table(self.spark, c.x, c.y, c.topology, order or c.neighborhood_order, wrap, c.hex_geometry)

    def set_neighborhood_order(self, order: int) -> FeatureMap:
        self.config = replace(self.config, neighborhood_order=order)
        return self

    # ---- queries

    def identify(self, df: DataFrame, second: bool = False) -> DataFrame:
        """``df`` with each row's nearest neuron (and the second): ids, distances, grid cell."""
        strategy = self.config.strategy if self.config.strategy in ("sql", "arrow") else "arrow"
        book = self.codebook() if strategy == "sql" else self.weights
        got = bmu.assign(df, book, self.config.distance, self.features, strategy, second, self.row_id)
        return got.withColumns({"row": F.floor(F.col("nid1") / self.config.y).cast("int"), "col": (F.col("nid1") % self.config.y).cast("int")})

    def identify_one(self, sample: list[float] | np.ndarray) -> tuple[int, int]:
        """Row and column of one sample's best unit."""
        x = np.asarray(sample, dtype=float)[None, :]
        bmu.check_features(x, self.weights)
        return divmod(int(nearest(x, self.weights, self.config.distance, 1)[0][0, 0]), self.config.y)

    def quantization_error(self, df: DataFrame) -> float:
        return quality.quantization_error(self.identify(df.select(*self._ids(df), self.features))).first()["qe"]

    def topographic_error(self, df: DataFrame) -> float | None:
        """The share (not percentage) of rows whose two best units are not adjacent."""
        c = self.config
        if c.neurons == 1:
            return None
        return quality.topographic_error(self.identify(df.select(*self._ids(df), self.features), second=True), c.x, c.y, c.topology, c.pbc).first()["te"]

    def _ids(self, df: DataFrame) -> list[str]:
        return [self.row_id] if self.row_id in df.columns else []

    # ---- maps

    def build_map(self, kind: str, data: DataFrame | None = None, target: str | None = None, bmus: DataFrame | None = None, **options) -> DataFrame:
        if kind not in MAP_TYPES:
            raise ValueError(f"unknown map type {kind!r}; available: {', '.join(MAP_TYPES)}")
        if kind in NEEDS_TARGET and target is None:
            raise ValueError(f"map type {kind!r} needs a target column")
        if kind != "distance" and data is None and bmus is None:
            raise ValueError(f"map type {kind!r} needs data" + (" or assigned rows" if kind in NEEDS_TARGET else ""))
        if kind == "distance":
            order = options.get("neighborhood_order")
            return maps.distance_map(self.codebook(), self.neighbors(order), options.get("distance") or self.config.distance, options.get("scaling", "sum"))
        rows = bmus if bmus is not None else self.identify(data)
        neurons = self.neurons()
        if kind == "hit":
            return maps.hit_map(neurons, rows)
        if kind == "bmus_data":
            return maps.bmus_data_map(rows, self.row_id)
        if kind == "metric":
            return maps.metric_map(neurons, rows, target, options["reduction"])
        if kind == "score":
            return maps.score_map(neurons, rows, target, options.get("total"))
        if kind == "rank":
            return maps.rank_map(neurons, rows, target)
        return maps.classification_map(neurons, rows, target, self.neighbors(options.get("neighborhood_order")))

    def build_maps(self, wanted: list[dict], data: DataFrame, target: str | None = None) -> dict[str, DataFrame]:
        """Several maps over one cached assignment, which ``release`` lets go.  Keys: the type, with its options as JSON if any."""
        rows = self.identify(data).persist()
        self._cached.append(rows)
        out = {}
        for w in wanted:
            options = w.get("kwargs", {})
            key = w["type"] + (f"_{json.dumps(options, sort_keys=True)}" if options else "")
            out[key] = self.build_map(w["type"], data, target, rows, **options)
        return out

    def release(self) -> FeatureMap:
        """Let go of the assignments that ``build_maps`` cached, once its maps have been read."""
        while self._cached:
            self._cached.pop().unpersist()
        return self

    def component_planes(self) -> DataFrame:
        return maps.component_planes(self.codebook())

    def all_tables(self, data: DataFrame, target: str | None = None) -> dict[str, DataFrame]:
        """What a full report draws: training curve, distance and hit maps, target maps and planes."""
        wanted = [{"type": "distance"}, {"type": "hit"}]
        if target:
            wanted += [{"type": "metric", "kwargs": {"reduction": r}} for r in ("mean", "std")] + [{"type": "score"}, {"type": "rank"}]
        return self.build_maps(wanted, data, target) | {"training": self.history_table(), "planes": self.component_planes()}

    def draw_all(self, folder: str, data: DataFrame, target: str | None = None, names: list[str] | None = None) -> list[str]:
        """The full report as SVG files in a folder of the driver: curves, maps and component planes."""
        files, every = [], self.all_tables(data, target)
        planes, history = every.pop("planes"), every.pop("training")
        if self.history:
            files.append(render.save_svg(render.curves_svg(history, "epoch", ["qe", "te_pct"], "training"), folder, "training"))
        for key, cells in every.items():
            title = key.replace('_{"reduction": "', " ").replace('"}', "")
            files.append(render.save_svg(render.map_svg(cells, title, self.config.topology), folder, title.replace(" ", "_")))
        for f in range(self.weights.shape[1]):
            name = names[f] if names else f"component {f + 1}"
            cells = planes.filter(F.col("feature") == f)
            files.append(render.save_svg(render.map_svg(cells, name, self.config.topology, mask_zeros=False, flip=self.config.topology == "rectangular"), folder, name.replace(" ", "_")))
        self.release()
        return files

    # ---- retrieval and clustering

    def index(self, data: DataFrame) -> DataFrame:
        return maps.bmu_index(self.identify(data.select(self.row_id, self.features)), self.row_id)

    def collect_samples(self, queries: DataFrame, index: DataFrame, mode: str = "bmu_neighborhood_knn", threshold: int = 50, historical: DataFrame | None = None, query_id: str = "query_id") -> DataFrame:
        """Historical rows for every query (``query_id`` and features) by tiers."""
        own = bmu.assign(queries.select(query_id, self.features), self.weights, self.config.distance, self.features, "arrow", False)
        asked = own.select(F.col(query_id).alias("query_id"), F.col("nid1").alias("bmu"))
        return retrieval.collect_samples(asked, index, self.codebook(), self.neighbors(wrap=self.config.pbc), mode, threshold, self.config.distance, historical)

    def cluster(self, method: str = "kmeans", k: int | None = None, space: str = "weights", **options) -> tuple[clustering.Clustering, DataFrame]:
        """Clusters of the neurons and one row of all scores."""
        c = self.config
        gx, gy = lattice.positions(c.x, c.y, c.topology, c.hex_geometry)
        data = clustering.cluster_features(self.weights, gx, gy, space)
        found = clustering.cluster(self.spark, data, method, k, **options)
        rows = [(i, i // c.y, i % c.y, int(v), [float(a) for a in f]) for i, (v, f) in enumerate(zip(found.labels, data, strict=True))]
        points = self.spark.createDataFrame(rows, "id int, row int, col int, label int, features array<double>")
        return found, scores.all_scores(points, c.x, c.y, c.topology)

    def compare_clusters(self, wanted: list[dict]) -> DataFrame:
        """``method``, ``space``, ``n_clusters`` and all scores, one row for each wanted clustering."""
        out: DataFrame | None = None
        for w in wanted:
            found, row = self.cluster(**w)
            row = row.drop("n_clusters").select(F.lit(found.method).alias("method"), F.lit(w.get("space", "weights")).alias("space"), F.lit(found.n_clusters).alias("n_clusters"), "*")
            out = row if out is None else out.unionByName(row)
        if out is None:
            raise ValueError("there is nothing to compare")
        return out

    def cluster_map(self, found: clustering.Clustering) -> DataFrame:
        return clustering.cluster_map(self.spark, found, self.config.y)

    # ---- files

    def save(self, path: str) -> None:
        tables.save_model(self.spark, path, self.config, self.weights, self.history)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureMap:
        config, weights, history = tables.load_model(spark, path)
        own = cls(spark, config, weights)
        own.history = history
        return own
