"""Queries over all 64 components, against NumPy."""

import numpy as np
import pytest

from conftest import SF
from gridloom.operators import clustering
from gridloom.plans import queries
from gridloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def vectors(duck):
    return np.array([v for (v,) in duck.execute("SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id").fetchall()])


def test_moments(spark, vectors):
    for name, value, want in (("column_covariance", "cov", np.cov(vectors.T)), ("gram_matrix", "gram", vectors.T @ vectors)):
        got = {(r["i"], r["j"]): r[value] for r in QUERIES[name](spark, SF).collect()}
        assert len(got) == 64 * 64
        assert np.allclose([[got[i, j] for j in range(64)] for i in range(64)], want, atol=1e-6)


def test_scores_and_centres(spark, vectors):
    keep = np.array([i for i in range(25) if i != 7])
    x, label = vectors[keep], keep // 5 // 2
    kinds = np.unique(label)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    a = np.array([d[i, (label == label[i]) & (np.arange(24) != i)].mean() for i in range(24)])
    b = np.array([min(d[i, label == k].mean() for k in kinds if k != label[i]) for i in range(24)])
    centre = np.array([x[label == k].mean(axis=0) for k in kinds])
    own = np.linalg.norm(x - centre[label], axis=1)
    spread = np.array([own[label == k].mean() for k in kinds])
    db = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(centre[i] - centre[j]) for j in kinds if j != i) for i in kinds])
    between = sum((label == k).sum() * ((centre[k] - x.mean(axis=0)) ** 2).sum() for k in kinds)
    ch = between / (len(kinds) - 1) / ((own**2).sum() / (24 - len(kinds)))
    for name, want in (("silhouette", ((b - a) / np.maximum(a, b)).mean()), ("davies_bouldin", db), ("calinski_harabasz", ch)):
        assert QUERIES[name](spark, SF).first()[name] == pytest.approx(want, abs=1e-5), name
    got = {(r["label"], r["feature"]): r["value"] for r in QUERIES["cluster_centers"](spark, SF).collect()}
    assert len(got) == 3 * 64
    assert np.allclose([[got[k, j] for j in range(64)] for k in kinds], centre, atol=1e-6)


def test_clusters_are_of_whole_weights(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(clustering, "cluster", lambda spark, data, *a, **b: seen.append(data) or clustering.Clustering(np.ones(len(data), int), data, "none", 1))
    monkeypatch.setattr(clustering, "inertia_curve", lambda spark, data, *a, **b: seen.append(data) or [(2, 1.0), (3, 0.5)])
    for name in ("cluster_kmeans", "cluster_gmm", "cluster_hdbscan", "auto_k", "cluster_gmm_large"):
        QUERIES[name](spark, SF)
    assert [x.shape for x in seen] == [(48, 64), (48, 64), (48, 64), (25, 64), (400, 64)]


def test_mixtures_have_two_components(spark):
    for name in ("cluster_gmm", "cluster_gmm_large"):
        assert {r["label"] for r in QUERIES[name](spark, SF).collect()} == {1, 2}


def test_mixture_of_high_dimension(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(size=(150, 64)), rng.normal(size=(150, 64)) + 1.0)) / 8
    got = clustering.gmm(spark, x, 2).labels
    same = (got == np.repeat((1, 2), 150)).mean()
    assert max(same, 1 - same) > 0.95


def test_local_ols_uses_every_input(spark):
    rows = {r["query_id"]: r for r in QUERIES["local_ols"](spark, SF).collect()}
    samples = {}
    for r in queries.collected(spark, SF, "bmu_neighborhood_knn").select("query_id", "features", "output").collect():
        samples.setdefault(r["query_id"], []).append((r["features"], r["output"]))
    assert set(rows) == set(samples) and all(len(r["coef"]) == 64 for r in rows.values())
    for q, own in samples.items():
        if len(own) > 100:
            x = np.column_stack((np.ones(len(own)), [f for f, _ in own]))
            assert np.allclose(rows[q]["coef"], np.linalg.lstsq(x, [y for _, y in own], rcond=None)[0], atol=1e-4)
