"""Training, maps, retrieval, clustering and files through the model and the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from gridloom.config import MapConfig
from gridloom.operators import bmu, clustering, prepare, quality, retrieval, scores, training
from gridloom.plans.model import FeatureMap
from gridloom.sources import render, tables
from gridloom.streaming import assign as streaming


def frame(spark, x, **more):
    names = list(more)
    rows = [(i, [float(v) for v in r], *(more[n][i] for n in names)) for i, r in enumerate(x)]
    kinds = "".join(f", {n} {'int' if isinstance(more[n][0], (int, np.integer)) else 'double'}" for n in names)
    return spark.createDataFrame([(a, b, *(float(v) if isinstance(v, float) else int(v) for v in c)) for a, b, *c in rows], f"row_id long, features array<double>{kinds}")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(42)
    x = np.concatenate([rng.normal(c, 0.5, (60, 4)) for c in (-3, 0, 3)])
    return x, np.repeat([0, 1, 2], 60)


@pytest.mark.parametrize("topology", ["rectangular", "hexagonal"])
@pytest.mark.parametrize("distance", ["euclidean", "cosine", "manhattan", "chebyshev"])
@pytest.mark.parametrize("neighborhood", ["gaussian", "mexican_hat", "bubble", "triangle"])
def test_training_sweep(data, topology, distance, neighborhood):
    for pbc in (False, True):
        config = MapConfig(4, 3, epochs=4, sigma=1.1, learning_rate=0.85, topology=topology, distance=distance, neighborhood=neighborhood, pbc=pbc)
        w, history = training.fit_passes(lambda w: training.partial_sums(data[0], w, config), data[0][:12].copy(), config)
        assert w.shape == (12, 4) and np.isfinite(w).all() and len(history) == 4
        assert all(q >= 0 and 0 <= t <= 100 for _, q, t in history)


def test_update_equals_sum_over_rows(data):
    x, _ = data
    config = MapConfig(3, 4, topology="hexagonal", pbc=True, hex_geometry="regular")
    w, lr, sigma = x[:12].copy(), 0.4, 1.3
    got = training.updated(w, training.partial_sums(x, w, config), training.Smoother(config), lr, sigma)
    d2 = training.Smoother(config).d2
    own = np.sqrt(((x[:, None] - w) ** 2).sum(axis=2)).argmin(axis=1)
    want = w + lr / len(x) * sum(np.exp(-d2[b] / (2 * sigma**2))[:, None] * (row - w) for b, row in zip(own, x, strict=True))
    assert np.allclose(got, want)
    flat = MapConfig(3, 4, pbc=True)
    assert np.allclose(training.Smoother(flat)(w, sigma), np.exp(-training.Smoother(flat).dx / (2 * sigma**2) - training.Smoother(flat).dy / (2 * sigma**2)).T @ w)


def test_strategies_agree(spark, data):
    df = frame(spark, data[0]).repartition(3)
    start = data[0][:9].copy()
    runs = [training.fit(df, MapConfig(3, 3, epochs=3, strategy=s), start) for s in ("local", "arrow")]
    assert np.allclose(runs[0][0], runs[1][0])
    assert np.allclose(runs[0][1], runs[1][1])


def test_many_tasks_add_on_executors(spark, data, monkeypatch):
    monkeypatch.setattr(training, "MANY_TASKS", 2)
    config = MapConfig(3, 3, epochs=2, strategy="arrow")
    many = training.fit(frame(spark, data[0]).repartition(6), config, data[0][:9].copy())
    assert np.allclose(many[0], training.fit(frame(spark, data[0]), MapConfig(3, 3, epochs=2), data[0][:9].copy())[0])


def test_mini_batches(spark, data):
    df = frame(spark, data[0])
    for strategy in ("local", "arrow"):
        config = MapConfig(3, 3, epochs=3, batch_size=60, strategy=strategy)
        a, b = (training.fit(df, config, data[0][:9].copy()) for _ in range(2))
        assert np.array_equal(a[0], b[0]) and a[1][-1][1] < a[1][0][1] * 1.05


def test_model_end_to_end(spark, data, tmp_path):
    x, y = data
    df = frame(spark, x, label=y, target=x[:, 0] * 2.0)
    model = FeatureMap(spark, MapConfig(5, 4, epochs=8, sigma=1.5, init="pca", neighborhood_order=2)).fit(df, "pca")
    assert len(model.history) == 8 and model.history[-1][1] < model.history[0][1]
    assert model.quantization_error(df) == pytest.approx(model.history[-1][1])
    assert model.topographic_error(df) * 100 == pytest.approx(model.history[-1][2])
    row, col = model.identify_one(x[0])
    first = model.identify(df).filter("row_id = 0").first()
    assert (first["row"], first["col"]) == (row, col)
    got = model.build_maps([{"type": t} for t in ("hit", "distance", "score", "rank", "classification")] + [{"type": "metric", "kwargs": {"reduction": "std"}}], df, "label")
    assert got["hit"].agg(F.sum("value")).first()[0] == len(x)
    assert got["distance"].agg(F.max("value")).first()[0] == pytest.approx(1.0)
    assert got["classification"].filter("value is not null").count() == got["hit"].filter("value > 0").count()
    assert 'metric_{"reduction": "std"}' in got
    assert set(model.all_tables(df, "target")) >= {"training", "planes", "hit", "distance", "rank"}
    model.save(str(tmp_path / "m"))
    again = FeatureMap.load(spark, str(tmp_path / "m"))
    assert again.config == model.config and np.allclose(again.weights, model.weights) and len(again.history) == 8
    svg = render.map_svg(got["hit"], "hits", "hexagonal", annotate=True)
    assert svg.count("<polygon") == 20 and render.map_svg(got["score"]).count("<rect") == 20
    assert "polyline" in render.curves_svg(model.history_table(), "epoch", ["qe", "te_pct"])
    assert (tmp_path / "f" / "hits.svg").as_posix() == render.save_svg(svg, str(tmp_path / "f"), "hits")
    index = model.index(df)
    found = model.collect_samples(df.limit(3).withColumnRenamed("row_id", "query_id"), index, threshold=30, historical=df.select("row_id", "target"))
    assert found.groupBy("query_id").count().filter("count <= 30").count() == 0
    assert model.set_neighborhood_order(1).config.neighborhood_order == 1
    result, row = model.cluster("kmeans", 3)
    assert set(result.labels) == {1, 2, 3} and row.first()["silhouette"] > 0


def test_map_errors(spark, data):
    df = frame(spark, data[0])
    model = FeatureMap(spark, MapConfig(2, 2), data[0][:4])
    for args in (("heat", df), ("hit",), ("metric", df), ("score", None, "row_id")):
        with pytest.raises(ValueError):
            model.build_map(*args)
    with pytest.raises(ValueError):
        model.build_map("metric", df, "row_id", reduction="median")
    with pytest.raises(ValueError):
        training.fit(df.filter("row_id < 0"), MapConfig(2, 2))
    with pytest.raises(ValueError):
        training.fit(df, MapConfig(2, 2, num_features=3))
    with pytest.raises(ValueError):
        model.identify_one([1.0, 2.0])


def test_unit_vectors(spark):
    assert np.allclose(np.linalg.norm(FeatureMap(spark, MapConfig(3, 3, num_features=7)).weights, axis=1), 1.0)


def weights_with(places):
    w = np.full((9, 2), 10.0)
    for k, v in places.items():
        w[k] = v
    return w


def test_topographic_error_cases(spark):
    df = frame(spark, [[0.0, 0.0]])
    for places, want in (({0: (0, 0), 4: (0, 0.5)}, 0.0), ({0: (0, 0), 6: (0, 0.5)}, 1.0)):
        got = quality.topographic_error(bmu.assign(df, weights_with(places)), 3, 3)
        assert got.first()["te"] == want
    with pytest.warns(UserWarning):
        assert quality.topographic_error(bmu.assign(df, np.zeros((1, 2))), 1, 1).first()["te"] is None


@pytest.mark.parametrize("filled, threshold, want", [({4: [0], 5: [1, 2]}, 3, [0, 1, 2]), ({5: [4, 5]}, 2, [4, 5]), ({}, 3, [])])
def test_retrieval_cases(spark, filled, threshold, want):
    w = weights_with({4: (0, 0), 5: (0.1, 0)})
    index = spark.createDataFrame([(n, r) for n, rows in filled.items() for r in rows], "neuron_id int, row_id long")
    model = FeatureMap(spark, MapConfig(3, 3), w)
    queries = spark.createDataFrame([(7, [0.0, 0.0])], "query_id long, features array<double>")
    got = model.collect_samples(queries, index, threshold=threshold).orderBy("seq").collect()
    assert [r["row_id"] for r in got] == want
    with pytest.raises(ValueError):
        model.collect_samples(queries, index, mode="all")


def test_retrieval_wraps_on_a_torus(spark):
    model = FeatureMap(spark, MapConfig(4, 4, pbc=True), np.arange(32.0).reshape(16, 2))
    index = spark.createDataFrame([(15, 1), (5, 2), (10, 3)], "neuron_id int, row_id long")
    queries = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, features array<double>")
    assert {r["row_id"] for r in model.collect_samples(queries, index, "bmu_neighborhood").collect()} == {1, 2}


def test_local_models(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    rows = [(i % 2, [float(v) for v in r], float(1 + r @ [1.0, -2.0, 3.0])) for i, r in enumerate(x)]
    got = retrieval.local_ols(spark.createDataFrame(rows, "query_id int, features array<double>, y double"), "features", "y").collect()
    assert all(np.allclose(r["coef"], [1, 1, -2, 3], atol=1e-5) for r in got)


def test_scores_degenerate(spark):
    points = lambda labels: spark.createDataFrame([(i, i, 0, v, [float(i), 1.0]) for i, v in enumerate(labels)], "id int, row int, col int, label int, features array<double>")
    one = scores.all_scores(points([1, 1, 1]), 3, 1).first()
    assert (one["silhouette"], one["davies_bouldin"], one["calinski_harabasz"], one["topological_quality"]) == (0.0, 0.0, 0.0, 1.0)
    noise = scores.all_scores(points([-1, -1]), 2, 1).first()
    assert (noise["silhouette"], noise["davies_bouldin"], noise["calinski_harabasz"]) == (0.0, float("inf"), 0.0)
    assert (noise["n_clusters"], noise["n_noise_points"], noise["noise_ratio"]) == (0, 2, 1.0)


def test_clustering(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (25, 3)) for c in (-5, 0, 5)])
    truth = np.repeat([0, 1, 2], 25)
    agree = lambda labels: len(set(zip(truth, labels, strict=True)))
    assert agree(clustering.kmeans(spark, x, 3, starts=3).labels) == 3
    mixed = clustering.gmm(spark, x, 3)
    assert agree(mixed.labels) == 3 and mixed.extra["bic"] > mixed.extra["aic"]
    dense = clustering.hdbscan(np.concatenate((x, [[40.0, -40.0, 40.0]])))
    assert dense.n_clusters == 3 and dense.labels[-1] == -1 and agree(dense.labels[:-1][dense.labels[:-1] > 0][:75]) >= 3
    assert clustering.hdbscan(rng.uniform(size=(8, 2)), min_cluster_size=8).n_clusters == 1
    assert clustering.elbow_of(clustering.inertia_curve(spark, x, 5, starts=2)) == 3
    assert clustering.elbow_of([(2, 1.0), (3, 0.5)]) == 2
    for bad in (np.zeros((0, 2)), np.zeros(3), np.zeros((1, 2))):
        with pytest.raises(ValueError):
            clustering.kmeans(spark, bad)
    for f in (lambda: clustering.cluster(spark, x, "ward"), lambda: clustering.cluster_features(x, x[:, 0], x[:, 1], "rows")):
        with pytest.raises(ValueError):
            f()
    assert clustering.cluster_features(x, x[:, 0], x[:, 1], "combined").shape == (75, 5)


def test_preparation(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0)], "id int, a double, b double")
    got = prepare.standardize(df, ["a", "b"]).orderBy("id").collect()
    assert [r["a"] for r in got] == [-1.0, 1.0] and [r["b"] for r in got] == [0.0, 0.0]
    vec = prepare.vectorize(df, ["a", "b"])
    assert vec.columns == ["id", "features"] and prepare.standardize_vectors(vec).first()["features"] == [-1.0, 0.0]
    assert prepare.shuffled_batches(df.withColumnRenamed("id", "row_id"), 1, 0).columns[-1] == "batch"
    assert prepare.drop_noise(df.withColumn("label", F.lit(-1))).count() == 0
    parts = prepare.train_test_split(spark.range(101).withColumnRenamed("id", "row_id"))
    assert parts.filter("is_train").count() == 80


def test_sources(spark, tmp_path):
    rows = tables.blobs(spark, 90, 5)
    assert rows.count() == 90 and rows.select("label").distinct().count() == 3 and len(rows.first()["features"]) == 5
    rows.select("row_id", "label").write.csv(str(tmp_path / "c"), header=True)
    assert tables.read_csv(spark, str(tmp_path / "c"), "row_id long, label int").count() == 90
    for _ in range(2):
        tables.append_results(rows.limit(1).select("label"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", F.array(F.col("value"), F.col("value") * 2).alias("features"))
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    w = np.array([[0.0, 0], [50, 100], [90, 180]])
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    job = streaming.write_assigned(stream, lambda: w, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination()
    static = streaming.assign_stream(events, w)
    assert spark.read.parquet(str(tmp_path / "out")).select("event_id", "nid1").exceptAll(static.select("event_id", "nid1")).count() == 0
    job = streaming.hits_by_window(streaming.assign_stream(stream, w)).writeStream.outputMode("complete").format("memory").queryName("hits").trigger(availableNow=True).start()
    job.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM hits").first()[0] == events.count()
    job = streaming.running_units(stream, w, "user_id").writeStream.outputMode("update").format("memory").queryName("moves").trigger(availableNow=True).start()
    job.awaitTermination()
    assert spark.sql("SELECT count(DISTINCT user_id) FROM moves").first()[0] == events.select("user_id").distinct().count()
