import numpy as np
import pandas as pd
import pytest

from scoreloom.operators import profile


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=500) + 1e6
    data = pd.DataFrame(
        {"a": a, "b": a + 0.3 * rng.normal(size=500), "c": a + 0.5 * rng.normal(size=500), "d": -a, "e": 3.0, "f": rng.normal(size=500)}
    )
    data.loc[::7, "b"] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in data.itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5), data


def test_matrix_equals_pandas(wide):
    df, data = wide
    got, want = profile.correlation_matrix(df, list(data)), data.corr()
    assert np.isnan(got.loc["e", "a"]) and got.loc["e", "e"] == 1
    names = list("abcdf")
    assert np.allclose(got.loc[names, names], want.loc[names, names], atol=1e-9)


def test_greedy_partners_of_a_chain():
    names = list("abc")
    chain = pd.DataFrame([[1, 0.9, 0.5], [0.9, 1, 0.85], [0.5, 0.85, 1]], names, names)
    assert profile.high_corr(chain) == {"a": ["b"], "b": ["c"], "c": []}
    assert profile.columns_to_drop(chain) == ["a", "b"]
    assert profile.high_corr(chain, 0.86) == {"a": ["b"], "b": [], "c": []}


def test_negative_correlation_is_only_seen_by_the_absolute_rule(wide):
    df, data = wide
    matrix = profile.correlation_matrix(df, list(data))
    assert "d" not in profile.columns_to_drop(matrix, 0.8)
    assert profile.keep_uncorrelated(matrix) == ["a", "c", "e", "f"]


def test_legacy_rule_drops_the_first_column():
    names = list("abc")
    matrix = pd.DataFrame([[1, 0.99, 0.1], [0.99, 1, 0.1], [0.1, 0.1, 1]], names, names)
    assert profile.keep_uncorrelated(matrix) == ["a", "c"]
    assert profile.keep_uncorrelated(matrix, legacy=True) == ["c"]


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i % 2), float(v)) for i, v in enumerate(rng.normal(size=1000))]
    df = spark.createDataFrame(rows, "y int, v double")
    curve = profile.kde_by_class(df, "v", "y").toPandas()
    for _, part in curve.groupby("y"):
        part = part.sort_values("x")
        assert np.trapezoid(part["density"], part["x"]) == pytest.approx(1, abs=0.03)
