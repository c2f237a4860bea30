"""Learning-rate and radius schedules: closed forms of the initial value at epochs 0 to T-1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lr_inverse(lr, t, T):
    gamma = T / 100
    return lr * gamma / (gamma + t)


def lr_linear(lr, t, T):
    return lr * (1 - t / T)


def sigma_inverse(sigma, t, T):
    return sigma / (1 + t * ((sigma - 1) / T))


def sigma_linear(sigma, t, T):
    return sigma + t * ((1 - sigma) / T)


def asymptotic(value, t, T):
    return value / (1 + t / (T / 2))


#: The forms work on numbers and on Columns alike.
DECAYS: dict[str, Callable] = {
    "lr_inverse_decay_to_zero": lr_inverse,
    "lr_linear_decay_to_zero": lr_linear,
    "sig_inverse_decay_to_one": sigma_inverse,
    "sig_linear_decay_to_one": sigma_linear,
    "asymptotic_decay": asymptotic,
}


def decay(name: str, value: float, t: Column | float, T: int):
    if name not in DECAYS:
        raise ValueError(f"unknown decay {name!r}; known: {', '.join(DECAYS)}")
    return DECAYS[name](value, t, T)


def schedule_table(spark: SparkSession, T: int, **columns: tuple[str, float]) -> DataFrame:
    """``epoch`` and a column for each ``name=(decay, initial value)``."""
    t = F.col("epoch").cast("double")
    return spark.range(T).select(F.col("id").alias("epoch")).select("epoch", *(decay(d, v, t, T).alias(k) for k, (d, v) in columns.items()))


def schedules(T: int, lr: tuple[str, float], sigma: tuple[str, float]) -> list[tuple[float, float]]:
    return [(decay(lr[0], lr[1], t, T), decay(sigma[0], sigma[1], t, T)) for t in range(T)]
