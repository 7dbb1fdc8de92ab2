import math

import numpy as np
import pandas as pd
import pytest

from scoreloom.operators import woe


@pytest.fixture(scope="module")
def risky():
    rng = np.random.default_rng(1)
    x = np.round(rng.gamma(2.0, 30.0, 1200), 1)
    y = (rng.random(1200) < 1 / (1 + np.exp(0.02 * x - 1))).astype(int)
    z = rng.integers(0, 4, 1200).astype(float)
    x[::9] = np.nan
    return pd.DataFrame({"x": x, "z": z, "y": y})


def frame(spark, data):
    rows = [
        tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r)
        for r in data.itertuples(index=False)
    ]
    return spark.createDataFrame(rows, "x double, z double, y int")


def brute_search(x, y, max_bins=20, threshold=0.8, force=3):
    keep = ~np.isnan(x)
    x, y = x[keep], y[keep]
    for n in range(max_bins, 1, -1):
        try:
            bucket = pd.qcut(x, n, labels=False)
        except ValueError:
            continue
        grouped = pd.DataFrame({"x": x, "y": y, "b": bucket}).groupby("b").mean()
        rho = grouped["x"].corr(grouped["y"], method=lambda a, b: woe.rank_correlation(np.array(a), np.array(b)))
        if abs(rho) >= threshold:
            return bucket
    return pd.qcut(x, force, labels=False, duplicates="drop")


def test_search_equals_brute_force(spark, risky):
    edges, cells = woe.numeric_edges(frame(spark, risky), ["x", "z"], "y")
    for c in ("x", "z"):
        x = risky[c].to_numpy()
        bucket = brute_search(x, risky["y"].to_numpy())
        known = risky[~np.isnan(x)].assign(b=bucket).groupby("b").agg(
            low=(c, "min"), high=(c, "max"), n=("y", "size"), d=("y", "sum")
        )
        rows = [r for r in woe.bin_rows(c, cells[c], edges[c]) if r[1] >= 0]
        assert [r[2:6] for r in rows] == [tuple(r) for r in known.itertuples(index=False)]


def test_missing_rows_have_their_own_bin(spark, risky):
    table = woe.woe_numeric(frame(spark, risky), ["x"], "y", bins=4).toPandas()
    gap = table[table["BIN"] == -1].iloc[0]
    missing = risky[risky["x"].isna()]
    assert gap["COUNT"] == len(missing) and gap["DEFAULT"] == missing["y"].sum()
    assert table["COUNT"].sum() == len(risky)
    assert table["DIST_DEFAULT"].sum() == pytest.approx(1)
    assert table["NONDIST_DEFAULT"].sum() == pytest.approx(1)


def test_woe_falls_with_the_event_rate(spark, risky):
    table = woe.woe_numeric(frame(spark, risky), ["x"], "y", bins=5).toPandas().sort_values("DEFAULT_RATE")
    assert table["WOE"].is_monotonic_decreasing


def test_empty_classes(spark):
    rows = [("a", 1)] * 3 + [("b", 0)] * 4 + [("c", 0), ("c", 1)] + [(None, 0)]
    df = spark.createDataFrame(rows, "s string, y int")
    table = {r["MIN_VALUE"]: r for r in woe.woe_categorical(df, ["s"], "y").collect()}
    assert table["a"]["WOE"] == 0 and table["b"]["WOE"] == 0 and table[None]["WOE"] == 0
    expected = math.log((1 / 6) / (1 / 4))
    assert table["c"]["WOE"] == pytest.approx(expected)
    assert all(r["IV"] == pytest.approx((1 / 6 - 1 / 4) * expected) for r in table.values())


def test_single_class_has_no_woe(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0)], "s string, y int")
    assert all(r["WOE"] is None and r["IV"] == 0 for r in woe.woe_categorical(df, ["s"], "y").collect())


def test_kinds(spark):
    rows = [(0, 1.0, None, 7), (1, 2.0, 1.0, 7), (0, 3.0, 2.0, 7)]
    df = spark.createDataFrame(rows, "two int, many double, gap double, one int")
    numeric, other, _ = woe.split_kinds(df, df.columns)
    assert numeric == ["many", "gap"] and other == ["two", "one"]


@pytest.mark.parametrize("binner", [woe.WoeBinner, woe.TreeWoeBinner])
def test_apply_and_save(spark, risky, binner, tmp_path):
    data = frame(spark, risky).selectExpr("x", "cast(z as string) AS z", "y")
    model = binner(["x", "z"], "y").fit(data)
    model.save(str(tmp_path / "woe"))
    again = woe.WoeModel.load(str(tmp_path / "woe"))
    first = model.transform(data).orderBy("x", "z", "y").toPandas()
    assert first.equals(again.transform(data).orderBy("x", "z", "y").toPandas())
    values = set(model.table.toPandas()["WOE"].round(9))
    assert set(first["x_woe"].round(9)) | set(first["z_woe"].round(9)) == values
    unseen = spark.createDataFrame([(1.0, "new", 0)], "x double, z string, y int")
    assert model.transform(unseen).first()["z_woe"] is None


def test_tree_respects_limits(spark, risky):
    table = woe.TreeWoeBinner(["x"], "y", max_bins=4, min_share=0.1, min_gain=0.0).fit(frame(spark, risky)).table
    bins = table.filter("MIN_VALUE is not null").toPandas()
    assert 2 <= len(bins) <= 4
    assert (bins["COUNT"] >= 0.1 * bins["COUNT"].sum()).all()


def test_approximate_quantiles_stay_close(spark, risky):
    exact, _ = woe.numeric_edges(frame(spark, risky), ["x"], "y", bins=4)
    close, _ = woe.numeric_edges(frame(spark, risky), ["x"], "y", bins=4, approximate=True)
    assert np.allclose(exact["x"], close["x"], atol=0.5)
