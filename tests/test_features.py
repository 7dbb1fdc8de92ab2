import numpy as np
import pytest

from scoreloom import session
from scoreloom.operators import features, kmeans, neighbors, resample


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(900, 3)) * [1, 5, 0.2], 3)
    x[600:] = x[600]  # a third of the rows are one point
    label = (np.arange(900) % 10 == 0).astype(int)
    rows = [(i, int(label[i]), *map(float, x[i])) for i in range(900)]
    return spark.createDataFrame(rows, "id long, label int, a double, b double, c double").repartition(6), x, label


COLUMNS = ["a", "b", "c"]


def test_min_max(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, None), (2.0, None, None)], "a double, b double, c double")
    model = features.MinMaxScaler(["a", "b", "c"]).fit(df)
    assert sorted(map(str, model.transform(df).collect())) == sorted(
        map(str, spark.createDataFrame([(0.0, 0.0, None), (1.0, 0.0, None), (0.5, None, None)], df.schema).collect())
    )


def test_components(cloud):
    df, x, _ = cloud
    model = features.PCAFeatures(COLUMNS, 0.97).fit(df)
    loadings = np.array(model.info["loadings"])
    assert np.allclose(loadings @ loadings.T, np.eye(len(loadings)), atol=1e-9)
    assert len(loadings) < 3 <= len(features.PCAFeatures(COLUMNS, 1.0).fit(df).info["loadings"])
    out = model.transform(df).orderBy("id").toPandas()
    centered = x - x.mean(axis=0)
    assert np.allclose(out[["pca_0"]].to_numpy(), centered @ loadings[:1].T)
    assert (loadings[np.arange(len(loadings)), np.abs(loadings).argmax(axis=1)] > 0).all()


@pytest.mark.parametrize("target", [None, "label"])
def test_cluster_distances(cloud, target):
    df, x, _ = cloud
    model = features.KMeansFeaturizer(COLUMNS, k=4, target=target, seeds=1, max_iter=5).fit(df)
    centers = np.array(model.info["centers"])
    assert centers.shape == (4, 3)
    got = np.stack(model.transform(df).orderBy("id").toPandas()["cluster_distance"].to_numpy())
    assert np.allclose(got, np.linalg.norm(x[:, None] - centers[None], axis=2))


def test_clusters_of_many_starts(spark):
    """The best start ends in a fixed point, finds separate clumps, and does not depend on partitions."""
    rng = np.random.default_rng(8)
    middle = np.array([[0, 0], [50, 0], [0, 50], [50, 50], [100, 100]], dtype=float) + 1e4
    x = np.concatenate([m + rng.normal(size=(60, 2)) for m in middle])
    frame = spark.createDataFrame([(p.tolist(),) for p in x], "x array<double>")
    centers, cost = kmeans.ManyStarts(5, starts=4, max_iter=20, seed=3).fit(frame.repartition(3))
    square = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
    assert np.isclose(cost, square.min(axis=1).sum())
    label = square.argmin(axis=1)
    assert np.allclose(centers, [x[label == j].mean(axis=0) for j in range(5)])
    assert np.allclose(sorted(np.round(centers, -1).tolist()), sorted(middle.tolist()))
    again, _ = kmeans.ManyStarts(5, starts=4, max_iter=20, seed=3).fit(frame.coalesce(1))
    assert np.allclose(centers, again)


def test_fewer_points_than_clusters(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_path", lambda spark, kind: f"file://{tmp_path}/{kind}")
    frame = spark.createDataFrame([([1.0],), ([1.0],), ([4.0],)], "x array<double>")
    centers, cost = kmeans.ManyStarts(5, starts=2).fit(frame)
    assert not (tmp_path / "frame").exists()
    assert sorted(centers.ravel()) == [1.0, 4.0] and cost == 0
    with pytest.raises(Exception, match="complete rows"):
        kmeans.ManyStarts(2, starts=2).fit(spark.createDataFrame([([1.0],), ([None],)], "x array<double>"))
    with pytest.raises(ValueError, match="at least one row"):
        kmeans.ManyStarts(2, starts=2).fit(frame.limit(0))


@pytest.mark.parametrize(("cell_points", "fanout"), [(20, 1000), (2000, 1000), (8, 3), (2, 4)])
def test_neighbours_equal_brute_force(spark, monkeypatch, cell_points, fanout):
    """One level, one cell, several levels, and cells that hold fewer than k points."""
    monkeypatch.setattr(neighbors, "MIN_CELL_POINTS", cell_points)
    monkeypatch.setattr(neighbors, "FANOUT", fanout)
    monkeypatch.setattr(neighbors, "ROOM", 50)
    rng = np.random.default_rng(4)
    # A wide cloud and a clump a thousand times as dense: cells of one level differ much in size.
    x = np.concatenate([rng.gamma(1.0, 2.0, size=(200, 2)), 1 + rng.gamma(1.0, 0.002, size=(200, 2))])
    x = np.unique(np.round(x, 4), axis=0)
    rows = [(str(i), int(i % 3 + 1), *map(float, p)) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, n int, a double, b double").repartition(5)
    out = neighbors.nearest_neighbors(df, ["a", "b"], "k", "n", 5).toPandas()
    distance = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(distance, np.inf)
    assert len(out) == 5 * len(x)
    for key, group in out.groupby("key"):
        assert np.allclose(np.sort(group["distance"]), np.sort(distance[int(key)])[:5])
        for r in group.itertuples():
            j = int(np.flatnonzero((x == np.array(r.neighbor)).all(axis=1))[0])
            assert r.times == j % 3 + 1


def test_oversampling(cloud):
    df, x, label = cloud
    out = resample.smote(df, COLUMNS, "label", "id", ratio=0.5, k=3, seed=1).toPandas()
    made = out[out["is_synthetic"] == 1]
    assert (out["label"] == 1).sum() == int(0.5 * 810) and len(made) == 405 - 90
    assert not out.duplicated(["id", "copy"]).any()
    minority = x[label == 1]
    for r in made.itertuples():
        base, point = x[r.id], np.array([r.a, r.b, r.c])
        assert label[r.id] == 1
        step = point - base
        away = minority - base
        norm = np.linalg.norm(away, axis=1)
        on_segment = (np.linalg.norm(away * (step @ away.T / np.maximum(norm**2, 1e-300))[:, None] - step, axis=1) < 1e-9) & (
            np.linalg.norm(step) <= norm + 1e-9
        )
        assert on_segment.any()
    twin = made[made["id"] >= 600]
    assert np.allclose(twin[COLUMNS].to_numpy(), x[600])


def test_oversampling_not_needed(cloud):
    df = cloud[0]
    assert resample.smote(df, COLUMNS, "label", "id", ratio=0.05).count() == 900
