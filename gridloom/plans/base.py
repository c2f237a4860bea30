"""The interface that own map models implement to work with the rest of the library."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame


class MapModel(ABC):
    """A trained map over DataFrames with a ``features`` array."""

    @abstractmethod
    def initialize(self, df: DataFrame, mode: str | None = None) -> MapModel:
        """Start weights from rows."""

    @abstractmethod
    def fit(self, df: DataFrame, init: str | None = None) -> MapModel:
        """Train on rows."""

    @abstractmethod
    def identify(self, df: DataFrame, second: bool = False) -> DataFrame:
        """Each row's nearest neuron, and the second."""

    @abstractmethod
    def quantization_error(self, df: DataFrame) -> float: ...

    @abstractmethod
    def topographic_error(self, df: DataFrame) -> float | None: ...

    @abstractmethod
    def build_map(self, kind: str, data: DataFrame | None = None, target: str | None = None, bmus: DataFrame | None = None, **options) -> DataFrame:
        """A map table by its registered type."""

    @abstractmethod
    def collect_samples(self, queries: DataFrame, index: DataFrame, mode: str, threshold: int, historical: DataFrame | None = None) -> DataFrame:
        """Historical rows for every query."""
