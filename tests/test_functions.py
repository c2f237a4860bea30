"""Hand-computed cases and invariants of the functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.config import MapConfig
from gridloom.functions import lattice, registry
from gridloom.functions.distances import COLUMNS, KERNELS, PAIRWISE, nearest
from gridloom.functions.neighborhoods import NEIGHBORHOODS
from gridloom.functions.schedules import DECAYS, decay, schedules


@pytest.mark.parametrize("bad", [{"x": 0}, {"y": 0}, {"epochs": 0}, {"batch_size": 0}, {"learning_rate": 0}, {"sigma": 0}, {"neighborhood_order": 0}, {"topology": "round"}, {"distance": "far"}, {"neighborhood": "none"}, {"lr_decay": "x"}, {"sigma_decay": "lr_linear_decay_to_zero"}, {"init": "x"}, {"strategy": "other"}])
def test_bad_config(bad):
    with pytest.raises(ValueError):
        MapConfig(**({"x": 3, "y": 3} | bad))


def test_config_round_trip_and_warning():
    c = MapConfig(4, 3, topology="hexagonal", pbc=True)
    assert MapConfig.from_json(c.to_json()) == c
    with pytest.warns(UserWarning):
        MapConfig(2, 2, sigma=9.0)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_agree_with_kernels(spark, name):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(20, 6)), rng.normal(size=(5, 6))
    x[0] = w[2]
    a = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>")
    b = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(w)], "j int, w array<double>")
    got = {(r["i"], r["j"]): r["d"] for r in a.crossJoin(b).select("i", "j", COLUMNS[name](F.col("x"), F.col("w")).alias("d")).collect()}
    d = KERNELS[name](x, w)
    assert all(abs(got[i, j] - d[i, j]) < 1e-6 for i in range(20) for j in range(5))
    assert np.allclose(PAIRWISE[name](x[:5], w), np.diag(d[:5]), atol=1e-6)
    ids, near = nearest(x, w, name, 3)
    want = np.array([[got[i, j] for j in range(5)] for i in range(20)])
    assert (ids == np.argsort(want, axis=1, kind="stable")[:, :3]).all()
    assert np.allclose(near, np.sort(want, axis=1)[:, :3], atol=1e-9)


def test_nearest_ties_go_to_the_lowest_id():
    ids, d = nearest(np.zeros((3, 2)), np.ones((40, 2)), k=2)
    assert ids.tolist() == [[0, 1]] * 3 and np.allclose(d, 2**0.5)
    assert nearest(np.array([[1.0, 0.0]]), np.array([[10, 10], *[[0, 0]] * 3, [1, 0], *[[0, 0]] * 4], dtype=float))[0][0, 0] == 4
    assert nearest(np.ones((2, 2)), np.zeros((3, 2)), lambda x, w: np.arange(6.0).reshape(2, 3))[0].tolist() == [[0], [0]]


def test_cosine_is_clamped():
    assert KERNELS["cosine"](np.array([[1.0, 0]]), np.array([[-1.0, 0], [0, 1], [2, 0]])).tolist() == [[1.0, 1.0, 0.0]]


def test_decays():
    assert all(decay(k, 2.0, 0, 100) == 2.0 for k in DECAYS)
    assert decay("lr_linear_decay_to_zero", 0.5, 50, 100) == 0.25
    assert decay("sig_inverse_decay_to_one", 3.0, 100, 100) == pytest.approx(1.0)
    assert decay("sig_linear_decay_to_one", 3.0, 100, 100) == pytest.approx(1.0)
    assert len(schedules(7, ("asymptotic_decay", 0.5), ("asymptotic_decay", 2.0))) == 7
    with pytest.raises(ValueError):
        decay("none", 1.0, 0, 1)


def test_neighborhoods():
    d2 = np.array([0.0, 1, 2, 4, 9])
    assert np.round(NEIGHBORHOODS["mexican_hat"](d2, 1.0), 4).tolist() == [1.0, 0.4549, 0.1839, 0.0, -0.0139]
    assert NEIGHBORHOODS["bubble"](d2, 1.5).tolist() == [1, 1, 1, 0, 0]
    assert NEIGHBORHOODS["triangle"](d2, 2.0).tolist() == pytest.approx([1, 0.5, 1 - 2**0.5 / 2, 0, 0])
    assert NEIGHBORHOODS["gaussian"](d2, 1.0)[0] == 1.0


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ring_sizes(n):
    assert len(lattice.rectangular_ring(n)) == 8 * n
    for geometry in ("shifted", "regular"):
        assert all(len(set(v)) == 6 * n for v in lattice.hexagonal_ring(n, geometry).values())


def test_hexagonal_rings():
    ring = lattice.hexagonal_ring(1)
    assert sorted(ring["even"]) == [(-1, 0), (-1, 1), (0, -1), (0, 1), (1, 0), (1, 1)]
    assert sorted(ring["odd"]) == [(-1, -1), (-1, 0), (0, -1), (0, 1), (1, -1), (1, 0)]
    assert lattice.six_neighbors(0, 1) == [(-1, 0), (-1, 1), (0, 0), (0, 2), (1, 0), (1, 1)]
    assert lattice.six_neighbors(1, 1) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 1), (2, 2)]
    regular = lattice.hexagonal_ring(1, "regular")
    assert sorted((1 + a, 1 + b) for a, b in regular["odd"]) == sorted(lattice.six_neighbors(1, 1))
    assert len(lattice.six_axial_neighbors(0, 0)) == 6
    assert lattice.offsets("rectangular", 0) == {"even": [], "odd": []}
    with pytest.raises(ValueError):
        lattice.offsets("round", 1)


def test_hexagonal_coordinates():
    for row in range(5):
        for col in range(4):
            q, r = lattice.offset_to_axial(row, col)
            assert lattice.axial_to_offset(q, r) == (row, col)
            assert sum(lattice.axial_to_cube(q, r)) == 0
            assert all(lattice.offset_distance(row, col, a, b) == 1 for a, b in lattice.six_neighbors(row, col))
    assert lattice.display_xy(0, 1) == pytest.approx((1.7320508, 0)) and lattice.display_xy(1, 0) == pytest.approx((0.8660254, 1.5))
    assert lattice.torus_offset_distance(0, 0, 5, 0, 6, 6) == 1


def test_grid_distances():
    d2 = lattice.grid_distance_sq(4, 2, "hexagonal")
    assert np.sqrt(d2[0, 2]) == 1.5 and np.sqrt(d2[2, 4]) == 0.5 and np.sqrt(d2[4, 6]) == 1.5
    assert np.sqrt(d2[0, 1]) == pytest.approx(0.8660254)
    torus = lattice.grid_distance_sq(6, 6, pbc=True)
    assert torus[0, 5] == torus[0, 30] == 1.0
    assert np.allclose(torus, torus.T) and not np.diag(torus).any()
    assert (torus <= lattice.grid_distance_sq(6, 6)).all()


def test_table_function(spark):
    registry.register_sql(spark)
    assert spark.sql("SELECT * FROM grid_neighbors(3, 3, 'rectangular', 1) WHERE neuron_id = 4").count() == 8
