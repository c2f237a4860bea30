"""Parameters of a map, validated once and used by every entry point."""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import asdict, dataclass, fields

TOPOLOGIES = ("rectangular", "hexagonal")
DISTANCES = ("euclidean", "cosine", "manhattan", "chebyshev")
NEIGHBORHOODS = ("gaussian", "mexican_hat", "bubble", "triangle")
LR_DECAYS = ("lr_inverse_decay_to_zero", "lr_linear_decay_to_zero", "asymptotic_decay")
SIGMA_DECAYS = ("sig_inverse_decay_to_one", "sig_linear_decay_to_one", "asymptotic_decay")
INITS = ("random", "pca", "none")
STRATEGIES = ("auto", "arrow", "sql", "local")
GEOMETRIES = ("shifted", "regular")


@dataclass(frozen=True)
class MapConfig:
    """``batch_size`` None trains on the full batch.  ``hex_geometry`` "shifted" keeps the historical
    training lattice (odd rows half a row down, columns times sqrt(3)/2) and ring offsets; "regular"
    staggers odd rows to the right everywhere."""

    x: int
    y: int
    num_features: int | None = None
    epochs: int = 10
    batch_size: int | None = None
    sigma: float = 1.0
    learning_rate: float = 0.5
    neighborhood_order: int = 1
    topology: str = "rectangular"
    lr_decay: str = "asymptotic_decay"
    sigma_decay: str = "asymptotic_decay"
    neighborhood: str = "gaussian"
    distance: str = "euclidean"
    init: str = "random"
    pbc: bool = False
    strategy: str = "auto"
    seed: int = 42
    hex_geometry: str = "shifted"

    def __post_init__(self) -> None:
        for name in ("x", "y", "epochs", "neighborhood_order"):
            if int(getattr(self, name)) < 1:
                raise ValueError(f"{name} must be at least 1")
        for name in ("sigma", "learning_rate"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be positive")
        if self.batch_size is not None and self.batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        if self.num_features is not None and self.num_features < 1:
            raise ValueError("num_features must be at least 1")
        for name, known in (("topology", TOPOLOGIES), ("distance", DISTANCES), ("neighborhood", NEIGHBORHOODS), ("lr_decay", LR_DECAYS), ("sigma_decay", SIGMA_DECAYS), ("init", INITS), ("strategy", STRATEGIES), ("hex_geometry", GEOMETRIES)):
            value = getattr(self, name)
            if value not in known and not callable(value):
                raise ValueError(f"{name} must be one of {', '.join(known)}; got {value!r}")
        if self.sigma > math.hypot(self.x, self.y):
            warnings.warn("sigma is larger than the map's diagonal", stacklevel=2)

    @property
    def neurons(self) -> int:
        return self.x * self.y

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> MapConfig:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(text).items() if k in known})
