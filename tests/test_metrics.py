import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from scoreloom.operators import metrics, ordering


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(0)
    label = rng.integers(0, 2, 2000)
    score = np.round(rng.random(2000) * 0.7 + label * 0.3, 2)
    rows = [(int(i), int(y), float(s), int(i % 3)) for i, (y, s) in enumerate(zip(label, score))]
    return spark.createDataFrame(rows, "id long, label int, score double, fold int").repartition(5)


@pytest.mark.parametrize("rows_per_bucket", [5, 10**9])
def test_auc_equals_exact_evaluator(scored, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", rows_per_bucket)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
    row = metrics.auc_gini(scored).first()
    assert row["auc"] == pytest.approx(evaluator.evaluate(scored), abs=1e-12)
    assert row["gini"] == pytest.approx(2 * row["auc"] - 1)


def test_auc_edge_cases(spark):
    same = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    assert metrics.auc_gini(same).first()["auc"] == 0.5
    single = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double")
    assert metrics.auc_gini(single).first()["auc"] is None


def test_mean_roc_equals_interpolation(scored):
    frame = scored.toPandas()
    grid = np.linspace(0, 1, 100)
    curves = []
    for _, part in frame.groupby("fold"):
        cut = np.sort(part["score"].unique())[::-1]
        pos, neg = (part["label"] == 1), (part["label"] == 0)
        tpr = np.r_[0, [((part["score"] >= c) & pos).sum() / pos.sum() for c in cut]]
        fpr = np.r_[0, [((part["score"] >= c) & neg).sum() / neg.sum() for c in cut]]
        curve = np.interp(grid, fpr, tpr)
        curve[0] = 0
        curves.append(curve)
    mean = np.mean(curves, axis=0)
    mean[-1] = 1
    got = metrics.mean_roc(scored).orderBy("step").toPandas()
    assert np.allclose(got["mean_tpr"], mean)
    area = metrics.mean_roc_area(metrics.mean_roc(scored)).first()[0]
    assert area == pytest.approx(np.trapezoid(mean, grid))


def test_f1_and_brier(scored):
    frame = scored.toPandas()
    best = 0
    for c in frame["score"].unique():
        hit = ((frame["score"] >= c) & (frame["label"] == 1)).sum()
        best = max(best, 2 * hit / ((frame["score"] >= c).sum() + frame["label"].sum()))
    assert metrics.max_f1(scored).first()["max_f1"] == pytest.approx(best)
    error = ((frame["score"] - frame["label"]) ** 2).mean()
    assert metrics.brier(scored).first()["neg_brier"] == pytest.approx(-error)


def test_roc_starts_at_the_origin(scored):
    points = metrics.roc_points(scored, by=["fold"]).filter("threshold is null").collect()
    assert sorted(r["fold"] for r in points) == [0, 1, 2]
    assert all(r["fpr"] == r["tpr"] == 0 for r in points)
