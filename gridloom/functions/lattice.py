"""Lattice geometry: positions, grid distances, rings of neighbours, hexagonal coordinates.

Small tables are generated on the driver with NumPy and become DataFrames of K or K x ring rows;
coordinate functions are plain arithmetic and work on numbers, arrays and Columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT3 = 3**0.5


def odd(row):
    return row.bitwiseAND(F.lit(1)) if isinstance(row, Column) else row & 1


def absolute(v):
    return F.abs(v) if isinstance(v, Column) else abs(v)


# ---- positions and grid distances


def positions(x: int, y: int, topology: str = "rectangular", geometry: str = "shifted") -> tuple[np.ndarray, np.ndarray]:
    """Training coordinates (gx, gy) by neuron id = row * y + col."""
    row, col = np.divmod(np.arange(x * y), y)
    if topology == "rectangular":
        return row.astype(float), col.astype(float)
    if geometry == "regular":
        return row * ROOT3 / 2, col + 0.5 * (row & 1)
    return row + 0.5 * (row & 1), col * ROOT3 / 2


def periods(x: int, y: int, topology: str, geometry: str = "shifted") -> tuple[float, float]:
    if topology == "rectangular":
        return float(x), float(y)
    return (x * ROOT3 / 2, float(y)) if geometry == "regular" else (float(x), y * ROOT3 / 2)


def minimum_image(delta, length: float):
    whole = F.round(delta / length) if isinstance(delta, Column) else np.round(delta / length)
    return delta - length * whole


def grid_distance_sq(x: int, y: int, topology: str = "rectangular", pbc: bool = False, geometry: str = "shifted") -> np.ndarray:
    """Squared lattice distances of all pairs, (K, K)."""
    dx, dy = axis_distance_sq(x, y, topology, pbc, geometry)
    return dx + dy


def axis_distance_sq(x: int, y: int, topology: str, pbc: bool, geometry: str = "shifted") -> tuple[np.ndarray, np.ndarray]:
    gx, gy = positions(x, y, topology, geometry)
    dx, dy = gx[:, None] - gx[None, :], gy[:, None] - gy[None, :]
    if pbc:
        lx, ly = periods(x, y, topology, geometry)
        dx, dy = minimum_image(dx, lx), minimum_image(dy, ly)
    return dx * dx, dy * dy


def neuron_table(spark: SparkSession, x: int, y: int, topology: str = "rectangular", geometry: str = "shifted") -> DataFrame:
    """``neuron_id``, ``row``, ``col``, ``gx``, ``gy``."""
    row, col = F.expr(f"cast(id div {y} as int)"), (F.col("id") % y).cast("int")
    if topology == "rectangular":
        gx, gy = F.col("row").cast("double"), F.col("col").cast("double")
    elif geometry == "regular":
        gx, gy = F.col("row") * (ROOT3 / 2), F.col("col") + 0.5 * odd(F.col("row"))
    else:
        gx, gy = F.col("row") + 0.5 * odd(F.col("row")), F.col("col") * (ROOT3 / 2)
    return spark.range(x * y).select(F.col("id").cast("int").alias("neuron_id"), row.alias("row"), col.alias("col")).withColumns({"gx": gx, "gy": gy})


def grid_distance_table(neurons: DataFrame, x: int, y: int, topology: str, pbc: bool, geometry: str = "shifted") -> DataFrame:
    """``a``, ``b``, ``d2`` of all pairs of neurons: a table of K x K rows, K being a map's size."""
    other = neurons.select(F.col("neuron_id").alias("b"), F.col("gx").alias("bx"), F.col("gy").alias("by"))
    dx, dy = F.col("gx") - F.col("bx"), F.col("gy") - F.col("by")
    if pbc:
        lx, ly = periods(x, y, topology, geometry)
        dx, dy = minimum_image(dx, lx), minimum_image(dy, ly)
    return neurons.crossJoin(F.broadcast(other)).select(F.col("neuron_id").alias("a"), "b", (dx * dx + dy * dy).alias("d2"))


# ---- rings of neighbours


def rectangular_ring(n: int) -> list[tuple[int, int]]:
    """The 8n offsets at Chebyshev distance n."""
    return [(r, c) for r in range(-n, n + 1) for c in range(-n, n + 1) if max(abs(r), abs(c)) == n] if n > 0 else []


def hexagonal_ring(n: int, geometry: str = "shifted") -> dict[str, list[tuple[int, int]]]:
    """The 6n offsets at axial distance n, for even and odd rows.

    "shifted" converts as if even rows lay to the right, "regular" as if odd rows did.
    """
    cells = [(q, r) for r in range(-n, n + 1) for q in range(-n, n + 1) if max(abs(q), abs(r), abs(q + r)) == n] if n > 0 else []
    up, down = [(r, q + (r + (r & 1)) // 2) for q, r in cells], [(r, q + (r - (r & 1)) // 2) for q, r in cells]
    return {"even": up, "odd": down} if geometry == "shifted" else {"even": down, "odd": up}


def offsets(topology: str, order: int, geometry: str = "shifted") -> dict[str, list[tuple[int, int, int]]]:
    """(ring, row offset, column offset) of all rings up to ``order``, by row parity."""
    if topology == "rectangular":
        every = [(n, r, c) for n in range(1, order + 1) for r, c in rectangular_ring(n)]
        return {"even": every, "odd": every}
    if topology == "hexagonal":
        rings = {n: hexagonal_ring(n, geometry) for n in range(1, order + 1)}
        return {p: [(n, r, c) for n, ring in rings.items() for r, c in ring[p]] for p in ("even", "odd")}
    raise ValueError(f"unknown topology {topology!r}")


def neighbor_list(x: int, y: int, topology: str, order: int, wrap: bool = False, geometry: str = "shifted") -> list[tuple[int, int, int, int]]:
    """(neuron, neighbour, ring, place): cells outside the grid are left out, or wrapped and made distinct."""
    own, out = offsets(topology, order, geometry), []
    for row in range(x):
        for col in range(y):
            seen = {row * y + col} if wrap else set()
            for place, (ring, dr, dc) in enumerate(own["odd" if row & 1 else "even"]):
                r, c = row + dr, col + dc
                if wrap:
                    r, c = r % x, c % y
                elif not (0 <= r < x and 0 <= c < y):
                    continue
                if r * y + c not in seen:
                    if wrap:
                        seen.add(r * y + c)
                    out.append((row * y + col, r * y + c, ring, place))
    return out


def neighbor_table(spark: SparkSession, x: int, y: int, topology: str, order: int, wrap: bool = False, geometry: str = "shifted") -> DataFrame:
    """``neuron_id``, ``nbr_id``, ``ring``, ``place``: generated on the driver, a few rows for each neuron."""
    return spark.createDataFrame(neighbor_list(x, y, topology, order, wrap, geometry), "neuron_id int, nbr_id int, ring int, place int")


# ---- hexagonal coordinates (odd rows lie to the right)


def offset_to_axial(row, col):
    return col - (row - odd(row)) / 2, row * 1.0


def axial_to_offset(q, r):
    if isinstance(q, Column):
        row = r.cast("int")
        return row, (q + F.floor((row - odd(row)) / 2)).cast("int")
    row = int(r)
    return row, int(q + (row - (row & 1)) // 2)


def axial_to_cube(q, r):
    return q, -q - r, r


def cube_to_axial(x, y, z):
    return x, z


def axial_distance(q1, r1, q2, r2):
    d = (absolute(q1 - q2) + absolute(r1 - r2) + absolute(q1 + r1 - q2 - r2)) / 2
    return d.cast("int") if isinstance(d, Column) else d.astype(int) if isinstance(d, np.ndarray) else int(d)


def offset_distance(row1, col1, row2, col2):
    return axial_distance(*offset_to_axial(row1, col1), *offset_to_axial(row2, col2))


def torus_offset_distance(row1, col1, row2, col2, x: int, y: int):
    """The least distance to the nine images of the second cell; asymmetric for an odd number of rows."""
    images = [offset_distance(row1, col1, row2 + dr, col2 + dc) for dr in (-x, 0, x) for dc in (-y, 0, y)]
    if isinstance(images[0], Column):
        return F.least(*images)
    return np.min(images, axis=0) if isinstance(images[0], np.ndarray) else min(images)


def display_xy(row, col, radius: float = 1.0):
    return (col + 0.5 * odd(row)) * (radius * ROOT3), row * (1.5 * radius)


def plot_xy(row, col):
    return col + 0.5 * odd(row), row * (ROOT3 / 2)


def six_neighbors(row: int, col: int) -> list[tuple[int, int]]:
    """The adjacent cells in order of row and column; odd rows lie to the right."""
    right = row & 1
    return [(row - 1, col - 1 + right), (row - 1, col + right), (row, col - 1), (row, col + 1), (row + 1, col - 1 + right), (row + 1, col + right)]


def six_axial_neighbors(q: int, r: int) -> list[tuple[int, int]]:
    return sorted((q + dq, r + dr) for dq in (-1, 0, 1) for dr in (-1, 0, 1) if abs(dq + dr) <= 1 and (dq or dr))
