"""Quantization and topographic error of assigned rows (``nid1``, ``d1``, ``nid2``)."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.lattice import minimum_image, offset_distance, torus_offset_distance
from gridloom.operators.prepare import grid_cell

#: The 8-neighborhood: diagonals (1.414) are adjacent, two cells apart are not.
ADJACENT = 1.42


def quantization_error(bmus: DataFrame) -> DataFrame:
    """``qe``: the mean distance to the nearest neuron."""
    return bmus.agg(F.avg("d1").alias("qe"))


def is_topographic_error(x: int, y: int, topology: str = "rectangular", pbc: bool = False) -> Column:
    """Whether the two nearest neurons of a row are not adjacent on the grid."""
    (r1, c1), (r2, c2) = grid_cell(F.col("nid1"), y), grid_cell(F.col("nid2"), y)
    if topology == "hexagonal":
        return (torus_offset_distance(r1, c1, r2, c2, x, y) if pbc else offset_distance(r1, c1, r2, c2)) > 1
    dr, dc = (r2 - r1).cast("double"), (c2 - c1).cast("double")
    if pbc:
        dr, dc = minimum_image(dr, float(x)), minimum_image(dc, float(y))
    return F.sqrt(dr * dr + dc * dc) > ADJACENT


def topographic_error(bmus: DataFrame, x: int, y: int, topology: str = "rectangular", pbc: bool = False) -> DataFrame:
    """``te``: the share of rows whose two nearest neurons are not adjacent; null on a map of one neuron."""
    if x * y == 1:
        warnings.warn("the topographic error is not defined for a map of one neuron", stacklevel=2)
        return bmus.agg(F.lit(None).cast("double").alias("te"))
    return bmus.agg(F.avg(is_topographic_error(x, y, topology, pbc).cast("double")).alias("te"))
