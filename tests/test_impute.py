import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import bpca, closest, impute


def brute_closest(rows):
    """rows: {id: values}; the closest candidate per incomplete row."""
    found = {}
    for i, a in rows.items():
        if None not in a:
            continue
        best = None
        for j, b in rows.items():
            if i == j or any(x is not None and y is not None and x != y for x, y in zip(a, b)):
                continue
            pair = (sum(x is None or y is None for x, y in zip(a, b)), j)
            best = pair if best is None or pair < best else best
        found[i] = best[1] if best else None
    return found


@pytest.mark.parametrize("share", [0.1, 0.5])
def test_closest_fit_equals_brute_force(spark, share):
    rng = np.random.default_rng(7)
    rows = {}
    for i in range(300):
        cells = [str(rng.integers(0, 3)), float(rng.integers(0, 4)), int(rng.integers(0, 3)), "x" if i % 3 else "y"]
        rows[i] = [None if rng.random() < share else c for c in cells]
    rows[300] = [None] * 4
    rows[301] = [None] * 4
    rows[302] = ["alone", None, 9, "z"]
    for i in range(303, 420):  # a hot group of equal rows
        rows[i] = ["0", None, 1, "x"]
    df = spark.createDataFrame([(i, *r) for i, r in rows.items()], "id long, a string, b double, c int, d string")
    out = {r["id"]: r for r in closest.closest_fit(df.repartition(5), ["a", "b", "c", "d"], "id").collect()}
    want = brute_closest(rows)
    assert len(out) == len(rows)
    for i, cells in rows.items():
        donor = want.get(i)
        assert out[i]["closest_id"] == donor
        given = rows[donor] if donor is not None else [None] * 4
        assert [out[i][c] for c in "abcd"] == [x if x is not None else g for x, g in zip(cells, given)]


def test_closest_fit_without_gaps(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, a string")
    assert closest.closest_fit(df, ["a"], "id").filter("closest_id is not null").count() == 0


def test_mean_imputer(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None)], "a double, b double")
    model = impute.MeanImputer(["a", "b"]).fit(df)
    assert model.info["means"] == {"a": 2.0, "b": 0.0}
    assert sorted(r["a"] for r in model.transform(df).collect()) == [1.0, 2.0, 3.0]


def test_hot_deck_reuses_donors_evenly(spark):
    train = spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, v double")
    test = spark.createDataFrame([(100 + i, None if i % 2 else -1.0) for i in range(25)], "id long, v double")
    out = impute.hot_deck_fill(train, test, ["v"], "id", 3).collect()
    assert len(out) == 25 and all(r["v"] is not None for r in out)
    assert all(r["v"] == -1.0 for r in out if r["id"] % 2 == 0)
    used = [r["v"] for r in out if r["v"] >= 0]
    assert max(used.count(v) for v in used) <= 3


@pytest.fixture(scope="module")
def plane(spark):
    rng = np.random.default_rng(11)
    z = rng.normal(size=(600, 2))
    x = z @ rng.normal(size=(2, 5)) + 0.05 * rng.normal(size=(600, 5)) + np.arange(5)
    holes = rng.random(x.shape) < 0.1
    holes[:, 0] = False
    data = np.where(holes, np.nan, x)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"x{i} double" for i in range(5))).repartition(6)
    return df, x, holes


NAMES = [f"x{i}" for i in range(5)]


def test_bpca_reconstructs_the_plane(spark, plane):
    _, x, _ = plane
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in NAMES))
    model = bpca.BayesianPCA(NAMES, updates=50).fit(df)
    out = model.reconstruct(df).orderBy("id").toPandas()
    error = ((out[[f"{n}_hat" for n in NAMES]].to_numpy() - x) ** 2).mean()
    assert error < 0.01 < x.var(axis=0).mean()
    likelihood = model.info["log_likelihood"]
    assert np.isfinite(likelihood).all() and abs(likelihood[-1] - likelihood[-2]) < 1e-3 * abs(likelihood[-1])
    assert (1 / np.array(model.info["alpha"]) > 0.05).sum() == 2
    assert model.transform(df).columns[-4:] == [f"z_{i}" for i in range(4)]


def test_bpca_batches_use_every_row(plane):
    df = plane[0].na.fill(0.0)
    whole = bpca.BayesianPCA(NAMES, updates=3).fit(df)
    split = bpca.BayesianPCA(NAMES, updates=3, batches=4, id_col="id").fit(df)
    assert len(whole.info["log_likelihood"]) == len(split.info["log_likelihood"]) == 3
    with pytest.raises(ValueError):
        bpca.BayesianPCA(NAMES, batches=4)


def test_bpca_imputer(plane):
    df, x, holes = plane
    model = bpca.BPCAImputer(NAMES, epochs=8).fit(df)
    kept = model.info["accepted_errors"]
    assert len(kept) >= 2 and all(b < a for a, b in zip(kept, kept[1:]))
    out = model.transform(df).orderBy("id").toPandas()[NAMES].to_numpy()
    assert np.array_equal(out[~holes], x[~holes])
    means = np.broadcast_to(np.nanmean(np.where(holes, np.nan, x), axis=0), x.shape)
    assert ((out - x)[holes] ** 2).mean() < ((means - x)[holes] ** 2).mean()


def test_update_equals_direct_sums():
    """One variational round from the statistics equals the same round written over rows."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4)) @ rng.normal(size=(4, 4))
    n, s, gram = float(len(x)), x.sum(axis=0), x.T @ x
    a = bpca.Posterior(n, s, gram, 1e-3, 1e-3)
    w, tau, mu, alpha, cov_w = a.w.copy(), a.tau, a.mu.copy(), a.alpha.copy(), a.cov_w.copy()
    a.update(n, s, gram)
    cov_z = np.linalg.inv(np.eye(3) + tau * (w.T @ w + 4 * cov_w))
    z = tau * (x - mu) @ w @ cov_z
    mu2 = tau / (1e-3 + n * tau) * (x - z @ w.T).sum(axis=0)
    cov2 = np.linalg.inv(np.diag(alpha) + tau * (n * cov_z + z.T @ z))
    w2 = (tau * cov2 @ z.T @ (x - mu2)).T
    assert np.allclose(a.mu, mu2) and np.allclose(a.w, w2) and np.allclose(a.cov_w, cov2)
    spread = n * 4 / (1e-3 + n * tau) + n * np.trace((w2.T @ w2 + 4 * cov2) @ cov_z)
    error = ((x - z @ w2.T - mu2) ** 2).sum() + spread + np.trace(4 * cov2 @ z.T @ z)
    assert a.tau == pytest.approx((1e-3 + n * 4 / 2) / (1e-3 + 0.5 * error))


def test_nan_counts_as_missing(spark):
    rows = [(float(i), float("nan") if i == 3 else 2.0 * i) for i in range(10)]
    df = spark.createDataFrame(rows, "x0 double, x1 double")
    out = bpca.BPCAImputer(["x0", "x1"], epochs=3).fit(df).transform(df)
    assert out.filter(F.isnan("x1") | F.col("x1").isNull()).count() == 0
