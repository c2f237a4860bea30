"""What must not depend on a table's size or layout, and clusters against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from gridloom.config import MapConfig
from gridloom.functions import lattice
from gridloom.operators import bmu, clustering, codebook, maps, prepare, retrieval, search, training
from gridloom.plans import queries
from gridloom.plans.model import FeatureMap
from gridloom.sources import render


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(range(len(x)) if ids is None else ids, x, strict=True)], "row_id long, features array<double>")


@pytest.mark.parametrize("topology", ["rectangular", "hexagonal"])
def test_mini_batches_are_the_same_everywhere(spark, topology):
    rng = np.random.default_rng(1)
    x, ids = rng.normal(size=(230, 4)), rng.integers(0, 60, 230)  # repeated ids
    df = frame(spark, x, ids).repartition(5)
    start = x[:12].copy()
    runs = [training.fit(df, MapConfig(4, 3, epochs=3, batch_size=50, topology=topology, strategy=s), start) for s in ("local", "arrow", "auto")]
    for w, history in runs[1:]:
        assert np.allclose(w, runs[0][0]) and np.allclose(history, runs[0][1])
    w, config = start.copy(), MapConfig(4, 3, epochs=3, batch_size=50, topology=topology)
    for epoch in range(3):  # row by row
        lr, sigma = 0.5 / (1 + epoch / 1.5), 1.0 / (1 + epoch / 1.5)
        d2 = training.Smoother(config).dx + training.Smoother(config).dy
        for b in range(5):
            own = x[[(((int(i) + 1) * pow(48271, epoch + 43, 2**31 - 1)) % (2**31 - 1)) % 5 == b for i in ids]]
            if len(own):
                near = ((own[:, None] - w) ** 2).sum(axis=2).argmin(axis=1)
                w = w + lr / len(own) * sum(np.exp(-d2[n] / (2 * sigma**2))[:, None] * (r - w) for n, r in zip(near, own, strict=True))
    assert np.allclose(w, runs[0][0])
    for strategy in ("local", "arrow", "auto"):
        with pytest.raises(ValueError):
            training.fit(df.select("features"), MapConfig(4, 3, batch_size=50, strategy=strategy), start)
    batch = {r["row_id"]: r["batch"] for r in prepare.shuffled_batches(df, 50, 1, 42).collect()}
    assert all(prepare.batch_number(np.int64(i), 5, 1, 42) == b for i, b in batch.items())


def test_assignment_does_not_depend_on_the_map_size(spark):
    x = np.random.default_rng(2).normal(size=(40, 3))
    df = frame(spark, x, [i % 7 for i in range(40)])  # repeated ids stay rows
    for k in (2, 16, 17):
        book = queries.codebook_table(spark, x[:k], 1)
        assert bmu.assign(df, book, second=False).count() == 40 and bmu.assign(df.drop("row_id"), book, second=False).count() == 40


def test_a_codebook_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(50, 3)), np.round(rng.normal(size=(30, 3)), 1)
    w[20:] = w[:10]  # ties across parts
    whole = {r["row_id"]: (r["units"], r["dists"]) for r in bmu.top_units(frame(spark, x), w, k=4).collect()}
    monkeypatch.setattr(bmu, "CODEBOOK_BYTES", 7 * 3 * 8)
    parts = {r["row_id"]: (r["units"], r["dists"]) for r in bmu.top_units(frame(spark, x), w, k=4).collect()}
    assert whole == parts


def test_search_strategies_agree(spark):
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=(60, 5)), rng.normal(size=(300, 5))
    df = frame(spark, x)
    want = {r["row_id"]: r["units"] for r in bmu.top_units(df, w, "euclidean", 3).collect()}
    for own in (search.BruteForce(), search.ProjectionIndex(step=8)):
        got = {r["row_id"]: (r["units"], r["dists"]) for r in bmu.top_units(df, w, own, 3).collect()}
        assert {k: v[0] for k, v in got.items()} == want
        for k, (units, dists) in got.items():
            assert np.allclose(dists, np.linalg.norm(w[units] - x[k], axis=1))


def test_numbering_and_labels_of_many_values(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = [f"v{i:03d}" for i in rng.permutation(300)] * 2
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string").repartition(6)
    few = sorted((r["v"] or "", r["label"] or 0) for r in prepare.encode_labels(df, "v").collect())
    monkeypatch.setattr(prepare, "BROADCAST_VALUES", 10)
    assert sorted((r["v"] or "", r["label"] or 0) for r in prepare.encode_labels(df, "v").collect()) == few
    assert few[0] == ("", 0) and few[1] == ("v000", 1) and few[-1] == ("v299", 300)


def test_split_with_repeated_ids(spark):
    rows = spark.range(1000).select((F.col("id") % 400).alias("row_id"))
    got = prepare.train_test_split(rows, share=0.5)
    assert got.groupBy("row_id").agg(F.count_distinct("is_train").alias("n")).filter("n > 1").count() == 0
    assert 490 <= got.filter("is_train").count() <= 510
    same = prepare.train_test_split(spark.range(100).select((F.col("id") * 1000003).alias("row_id")), share=0.37)  # one key for all
    assert same.filter("is_train").count() == 37


def test_moments_fold_on_executors(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(90, 3))
    df = frame(spark, x).repartition(9)
    monkeypatch.setattr(prepare, "MANY_TASKS", 2)
    n, total, gram = codebook.moments(df)
    assert n == 90 and np.allclose(total, x.sum(axis=0)) and np.allclose(gram, x.T @ x)
    n, mean, m2 = prepare.vector_moments(df)
    assert n == 90 and np.allclose(mean, x.mean(axis=0)) and np.allclose(m2 / 90, x.var(axis=0))


def test_order_of_collected_rows(spark):
    """Tier, place, neuron, row id: the order of every query's rows, with a neuron that holds most of them."""
    rng = np.random.default_rng(7)
    w = rng.normal(size=(9, 2))
    index = [(4 if i % 3 else int(rng.integers(9)), i) for i in rng.permutation(200).tolist()]
    asked = [(q, int(rng.integers(9))) for q in range(12)]
    neighbors = lattice.neighbor_table(spark, 3, 3, "rectangular", 1)
    near: dict = {}
    for r in sorted(neighbors.collect(), key=lambda r: (r["neuron_id"], r["place"])):
        near.setdefault(r["neuron_id"], []).append((r["place"], r["nbr_id"]))
    held: dict = {}
    for n, i in sorted(index):
        held.setdefault(n, []).append(i)
    want = {}
    for q, u in asked:
        rows = [(1, i) for i in held.get(u, [])] + [(2, i) for _, n in near[u] for i in held.get(n, [])]
        if len(rows) <= 60:
            rest = sorted((float(np.linalg.norm(w[u] - w[n])), n) for n in held if n != u and n not in {n for _, n in near[u]})
            for _, n in rest:
                if len(rows) > 60:
                    break
                rows += [(3, i) for i in held[n]]
        want[q] = rows
    got: dict = {q: [] for q, _ in asked}
    book = queries.codebook_table(spark, w, 3)
    found = retrieval.collect_samples(spark.createDataFrame(asked, "query_id long, bmu int"), spark.createDataFrame(index, "neuron_id int, row_id long").repartition(4), book, neighbors, threshold=60)
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["seq"])):
        got[r["query_id"]].append((r["tier"], r["row_id"]))
    assert got == want and found.groupBy("query_id").agg((F.max("seq") == F.count("*")).alias("ok")).filter("not ok").count() == 0


def test_principal_plane(duck, spark):
    x = np.array([v for (v,) in duck.execute("SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id").fetchall()])
    got = codebook.initial_weights(queries.samples(spark, SF), MapConfig(5, 5), "pca")
    values, vectors = np.linalg.eigh(np.cov(x.T))
    pc = vectors[:, ::-1][:, :2].T
    pc = pc * np.sign(pc[[0, 1], np.abs(pc).argmax(axis=1)])[:, None]
    grid = np.array([[a, b] for a in np.linspace(-1, 1, 5) for b in np.linspace(-1, 1, 5)])
    plane = grid @ pc
    assert np.allclose(got, plane * (x.std(ddof=1) / plane.std(ddof=1)) + x.mean(axis=0))


def test_kmeans_is_the_best_partition(spark):
    rng = np.random.default_rng(8)
    for k in (2, 3):
        x = rng.normal(size=(8, 2))
        cost = lambda labels, x=x: sum(((x[labels == c] - x[labels == c].mean(axis=0)) ** 2).sum() for c in np.unique(labels))
        best = min(cost(np.array(labels)) for labels in itertools.product(range(k), repeat=8))
        got = clustering.kmeans(spark, x, k)
        assert got.extra["inertia"] == pytest.approx(best) and cost(got.labels) == pytest.approx(best)
        assert np.allclose(got.centers, [x[got.labels == c].mean(axis=0) for c in range(1, k + 1)])


def test_mixtures_by_plain_densities(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 1.0, (60, 2)) @ np.array([[1.0, 0.3], [0.0, 0.7]]) for c in (-4, 0, 5)])
    for k in (1, 2, 3):
        got = clustering.gmm(spark, x, k)
        p = clustering.mixture_parameters(k, 2)
        total = (got.extra["aic"] - 2 * p) / -2
        assert got.extra["bic"] == pytest.approx(p * np.log(180) - 2 * total)
        if k == 1:
            cov = np.cov(x.T, bias=True)
            off = x - x.mean(axis=0)
            plain = (-0.5 * (2 * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off))).sum()
            assert total == pytest.approx(plain, rel=1e-4)
    hard = [x[got.labels == c] for c in (1, 2, 3)]  # well parted: each point has one component
    plain = sum((np.log(len(h) / 180) - 0.5 * (2 * np.log(2 * np.pi) + np.linalg.slogdet(np.cov(h.T, bias=True))[1] + np.einsum("ij,jk,ik->i", h - h.mean(axis=0), np.linalg.inv(np.cov(h.T, bias=True)), h - h.mean(axis=0)))).sum() for h in hard)
    assert total == pytest.approx(plain, rel=0.02)
    assert clustering.bic_k(spark, x) == 3 and clustering.gmm(spark, x).n_clusters == 3


def brute_density(x, least):
    """Labels by scanning all levels of the mutual-reachability graph: components at every threshold."""
    n = len(x)
    d = np.linalg.norm(x[:, None] - x, axis=2)
    core = np.sort(d, axis=1)[:, least - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core))
    np.fill_diagonal(reach, 0)

    def parts(points, level):
        left, out = set(points), []
        while left:
            work, own = [left.pop()], []
            while work:
                i = work.pop()
                own.append(i)
                new = [j for j in left if reach[i, j] <= level]
                left -= set(new)
                work += new
            out.append(sorted(own))
        return out

    levels = sorted(set(reach[np.triu_indices(n, 1)]), reverse=True)

    def grow(points, birth):
        """Stability of a cluster born at 1 / distance ``birth``, and its best clusters."""
        now, total = points, 0.0
        for k, level in enumerate(levels):
            below = levels[k + 1] if k + 1 < len(levels) else -1.0
            if len(parts(now, level)) > 1:
                continue
            split = parts(now, below)
            if len(split) == 1:
                continue
            at, big = 1 / level, [p for p in split if len(p) >= least]
            if len(big) > 1:
                total += len(now) * (at - birth)
                under = [grow(p, at) for p in big]
                best = sum(s for s, _ in under)
                return (total, [points]) if total >= best else (best, [c for _, cs in under for c in cs])
            total += (len(now) - sum(map(len, big))) * (at - birth)
            if not big:
                break
            now = big[0]
        return total, [points]

    now, birth = list(range(n)), 0.0
    for k, level in enumerate(levels):  # the root is no cluster
        below = levels[k + 1] if k + 1 < len(levels) else -1.0
        split = parts(now, below) if len(parts(now, level)) == 1 else [now]
        big = [p for p in split if len(p) >= least]
        if len(split) > 1 and len(big) > 1:
            return [c for p in big for c in grow(p, 1 / level)[1]]
        if len(split) > 1:
            if not big:
                break
            now = big[0]
    return []


@pytest.mark.parametrize("seed", range(6))
def test_density_clusters_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(rng.uniform(-6, 6, 2), rng.uniform(0.3, 1.2), (rng.integers(6, 14), 2)) for _ in range(3)] + [rng.uniform(-8, 8, (5, 2))])
    got = clustering.hdbscan(x, min_cluster_size=4)
    want = brute_density(x, 4)
    mine = sorted(sorted(np.flatnonzero(got.labels == c).tolist()) for c in np.unique(got.labels) if c > 0)
    want = sorted(want) if want else [list(range(len(x)))]
    d = np.linalg.norm(x[:, None] - x, axis=2)
    core = np.sort(d, axis=1)[:, 3]
    reach = np.maximum(d, np.maximum(core[:, None], core))
    assert len(mine) == len(want)
    for a, b in zip(mine, want, strict=True):
        assert set(b) <= set(a)
        for p in set(a) - set(b):  # leaves at the very level at which its cluster begins: a tie that a binary tree breaks
            level = reach[p, [q for q in b if q != p]].min()
            assert sum(np.isclose(w, level) for w, _, _ in clustering._spanning_tree(reach)) > 1


def test_inertia_curve_by_plain_sums(spark):
    x = np.random.default_rng(10).normal(size=(30, 3))
    for k, inertia in clustering.inertia_curve(spark, x, 5, starts=2):
        labels = clustering.kmeans(spark, x, k, starts=2).labels
        assert inertia == pytest.approx(sum(((x[labels == c] - x[labels == c].mean(axis=0)) ** 2).sum() for c in np.unique(labels)), rel=0.05)


def test_score_map_counts_rows_once(spark):
    rows = spark.createDataFrame([(i % 3, float(i * i)) for i in range(20)], "nid1 int, t double")
    neurons = lattice.neuron_table(spark, 2, 2)
    a, b = (sorted((r["row"], r["col"], r["value"] if r["value"] is None else round(r["value"], 9)) for r in maps.score_map(neurons, rows, "t", n).collect()) for n in (None, 20))
    assert a == b


def test_cluster_maps_and_report(spark, tmp_path):
    x = np.random.default_rng(11).normal(size=(60, 3))
    df = frame(spark, x).withColumn("t", F.col("features")[0])
    model = FeatureMap(spark, MapConfig(4, 3, epochs=3, init="pca")).fit(df, "pca")
    codes, names = clustering.plot_codes(np.array([5, -1, 2, 5]))
    assert codes.tolist() == [2, 0, 1, 2] and names == ["Uncertain", "2", "5"]
    assert clustering.plot_codes(np.array([3, 3]))[1] == ["3"]
    found, _ = model.cluster("kmeans", 2)
    assert model.cluster_map(found).select("value").distinct().count() == 2
    table = model.compare_clusters([{"method": "kmeans", "k": 2}, {"method": "kmeans", "k": 3, "space": "combined"}, {"method": "hdbscan"}])
    rows = table.collect()
    assert [(r["method"], r["space"]) for r in rows] == [("kmeans", "weights"), ("kmeans", "combined"), ("hdbscan", "weights")] and rows[1]["n_clusters"] == 3
    files = model.draw_all(str(tmp_path / "r"), df, "t")
    assert len(files) == 1 + 6 + 3 and all(open(f).read().startswith("<svg") for f in files) and not model._cached
    cells = spark.createDataFrame([(0, 0, 0.0), (1, 0, 2.0)], "row int, col int, value double")
    assert render.map_svg(cells).count('fill="none"') == 1 and render.map_svg(cells, mask_zeros=False).count('fill="none"') == 0
    assert render.map_svg(cells, mask_zeros=False, flip=True) != render.map_svg(cells, mask_zeros=False)
