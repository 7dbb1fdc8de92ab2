import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from scoreloom.operators import features, metrics, models, select, split, tune
from scoreloom.plans import jobs


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 4))
    y = (rng.random(600) < 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1]))).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i]), float(i % 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double, c double, d double, score double")
    return split.stratified_fold(df, "id", "label", 3).persist()


COLUMNS = ["a", "b", "c", "d"]
SMALL = {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.3}


@pytest.mark.parametrize("name", sorted(models.REGISTRY))
def test_contract(data, name, tmp_path):
    size = {"CatBoost": {"iterations": 3, "depth": 3}, "NGBoost": {"n_estimators": 3}, "LogisticRegression": {},
            "NeuralNetwork": {}}.get(name, {"n_estimators": 3, "max_depth": 3})
    model = models.registered(name, COLUMNS, **size).fit(data)
    out = model.transform(data)
    assert out.columns == ["id", "label", *COLUMNS, "fold", "score", "predicted"]
    row = out.agg(F.min("score"), F.max("score"), F.count("score")).first()
    assert 0 <= row[0] <= row[1] <= 1 and row[2] == 600
    if name != "NeuralNetwork":
        assert metrics.auc_gini(out).first()["auc"] > 0.6
    if name in ("XGBoost", "LogisticRegression"):
        model.save(str(tmp_path / "m"))
        again = models.ScoreModel.load(str(tmp_path / "m")).transform(data)
        assert again.orderBy("id").select("score").collect() == out.orderBy("id").select("score").collect()


def test_unknown_parameters_are_named():
    with pytest.raises(ValueError, match="num_leaves"):
        models.ScoreClassifier("lightgbm", COLUMNS, params={"num_leaves": 10})
    with pytest.raises(ValueError, match="dropout"):
        models.ScoreClassifier("neural_network", COLUMNS, params={"dropout": 0.3})
    with pytest.raises(ValueError, match="unknown learner"):
        models.ScoreClassifier("svm", COLUMNS)


def test_feature_may_be_called_score(data):
    base = [models.ScoreClassifier("lightgbm", [*COLUMNS, "score"], params=SMALL)]
    out = models.Blending(base).fit(data).transform(data)
    assert out.count() == 600


def test_early_stopping_uses_the_validation_rows(data):
    marked = data.withColumn("valid", F.col("fold") == 0)
    params = {"n_estimators": 30, "max_depth": 3, "learning_rate": 1.0}
    model = models.ScoreClassifier("lightgbm", COLUMNS, params=params, validation="valid").fit(marked)
    assert len(model.model.trees) < 30


@pytest.mark.parametrize("how", ["stacking", "holdout", "in_sample"])
def test_ensembles(data, how, tmp_path):
    base = [
        models.ScoreClassifier("lightgbm", COLUMNS, params=SMALL),
        models.ScoreClassifier("logistic_regression", COLUMNS),
    ]
    if how == "stacking":
        ensemble = models.Stacking(base, folds=2)
    else:
        ensemble = models.Blending(base, in_sample=how == "in_sample", use_features=how == "holdout")
    model = ensemble.fit(data)
    out = model.transform(data)
    assert metrics.auc_gini(out).first()["auc"] > 0.7
    model.save(str(tmp_path / "e"))
    again = models.EnsembleModel.load(str(tmp_path / "e")).transform(data)
    assert again.orderBy("id").select("score").collect() == out.orderBy("id").select("score").collect()


def test_prefix_scores_equal_smaller_models(data):
    big = models.ScoreClassifier("lightgbm", COLUMNS, params={**SMALL, "n_estimators": 4}).fit(data)
    staged = tune.staged_scores(data, big, [1, 4]).select("id", "scores")
    full = big.transform(data).select("id", F.col("score").alias("all"))
    one = models.ScoreClassifier("lightgbm", COLUMNS, params={**SMALL, "n_estimators": 1}).fit(data)
    first = one.transform(data).select("id", F.col("score").alias("one"))
    both = staged.join(full, "id").join(first, "id").toPandas()
    scores = np.stack(both["scores"].to_numpy())
    assert np.allclose(scores[:, 1], both["all"]) and np.allclose(scores[:, 0], both["one"])


def test_learning_curve_and_best(data):
    curve = tune.learning_curve(
        data.filter("fold <> 0"), data.filter("fold = 0"), COLUMNS, steps=[1, 2, 3], params={"learning_rate": 0.3}
    )
    rows = {r["iteration"]: r for r in curve.collect()}
    best = tune.best_iteration(curve)
    assert set(rows) == {1, 2, 3}
    assert best["best_auc"] == max(r["dev_auc"] for r in rows.values())
    assert tune.log_steps()[0] == 1 and tune.log_steps()[-1] == 500


def test_registered_curves_blending_and_selection_are_not_cut(spark, data, monkeypatch):
    from scoreloom.catalog import coding, learning

    seen = {}
    for name in ("learning_curve", "encoder_comparison"):
        monkeypatch.setattr(tune, name, lambda *a, _name=name, **how: seen.update({_name: how.get("steps")}))
    monkeypatch.setattr(learning, "numeric_pair", lambda *a: (data, data))
    monkeypatch.setattr(coding, "loan_pair", lambda *a: (data, data))
    monkeypatch.setattr(learning, "_scored", lambda spark, sf, estimator: estimator)
    monkeypatch.setattr(learning.jobs, "preprocess", lambda *a, **how: (None, how.get("folds", 5)))
    learning.learning_curve(spark, ""), coding.encoder_comparison(spark, "")
    assert all((s or tune.log_steps())[-1] == 500 for s in seen.values()) and len(seen) == 2
    assert len(learning.model_blending(spark, "").base) == 5 and learning.feature_select(spark, "") == 5


def test_folds_share_one_scan_for_sizes_and_ranges(data, monkeypatch):
    forest = models.ScoreClassifier("random_forest", COLUMNS, params={"n_estimators": 2, "max_depth": 3, "class_weight": "balanced"})
    line = models.ScoreClassifier("logistic_regression", COLUMNS[:2])
    jobs = [(e, k) for e in (forest, line) for k in (0, 1, None)]
    with_gap = data.withColumn("c", F.when(F.col("fold") == 0, F.col("c") + 100).otherwise(F.col("c"))).persist()
    alone = [e.fit(with_gap if k is None else with_gap.filter(F.col("fold") != k)) for e, k in jobs]
    scans, scan = [], models.row_facts
    monkeypatch.setattr(models, "row_facts", lambda *a: scans.append(a) or scan(*a))
    together = models.fit_together(with_gap, jobs, "fold")
    assert len(scans) == 1
    for a, b in zip(alone, together):
        assert a.info == b.info
        assert a.transform(data).orderBy("id").select("score").collect() == b.transform(data).orderBy("id").select("score").collect()


def test_ranges_hold_gaps_and_nan_as_in_spark(spark):
    rows = [(0, 0, 1.0, None), (0, 1, float("nan"), None), (1, 1, 3.0, None), (None, 1, 9.0, 1.0)]
    df = spark.createDataFrame(rows, "fold int, label int, a double, b double")
    facts, estimator = models.row_facts(df, "label", ["a", "b"], "fold"), models.ScoreClassifier("random_forest", ["a", "b"])
    assert facts.of(estimator, 0) == ({1: 1}, {"a": [3.0, 3.0], "b": [None, None]})
    sizes, ranges = facts.of(estimator)
    assert sizes == {0: 1, 1: 3} and ranges["a"][0] == 1.0 and ranges["a"][1] != ranges["a"][1] and ranges["b"] == [1.0, 1.0]
    with pytest.raises(ValueError, match="1 rows have no label"):
        models.row_facts(df.withColumn("label", F.when(F.col("a") != 3, 1)), "label", ["a"], "fold").of(estimator, 0)


def test_cross_validation_measures_both_splits(data):
    estimator = models.ScoreClassifier("logistic_regression", COLUMNS)
    out = tune.cross_validate(data, estimator).toPandas()
    assert len(out) == 6 and (out["auc"] > 0.7).all()


def test_ensembles_are_compared_with_single_learners(data):
    base = [models.ScoreClassifier("lightgbm", COLUMNS, params=SMALL), models.ScoreClassifier("xgboost", COLUMNS, params=SMALL)]
    out = {r["name"]: r for r in tune.compare(data, {"one": base[0], "both": models.Blending(base)}).collect()}
    assert out["one"]["folds"] == out["both"]["folds"] == 3 and min(r["mean_auc"] for r in out.values()) > 0.7


def test_grid_is_complete_and_sorted(data):
    out = tune.grid_search(data, "random_forest", COLUMNS, {"n_estimators": [1, 3], "max_depth": [1, 4]}).collect()
    assert len(out) == 4 and [r["mean_auc"] for r in out] == sorted((r["mean_auc"] for r in out), reverse=True)
    assert {tuple(sorted(r["params"].items())) for r in out} == {
        (("max_depth", d), ("n_estimators", n)) for d in "14" for n in "13"
    }


def test_selection(data):
    estimator = models.ScoreClassifier("random_forest", COLUMNS, params={"n_estimators": 5, "max_depth": 4})
    chosen, path = select.rfe_cv(data, estimator)
    assert "a" in chosen and [r["size"] for r in path.collect()] == [4, 3, 2, 1]
    chosen, path = select.sequential_backward(data, estimator, smallest=2, max_steps=1)
    assert len(path.collect()) == 2 and "a" in chosen
    shifted = data.withColumn("c", F.col("c") + 5)
    shift = select.CovariateShift(estimator, share=0.75).fit(data, shifted)
    assert shift.auc > 0.9 and shift.selected == ["a", "b", "d"]


def test_preprocess_keeps_the_same_columns(data):
    estimator = models.ScoreClassifier("random_forest", COLUMNS, params={"n_estimators": 3, "max_depth": 3})
    train, test = jobs.preprocess(data.drop("fold"), data.drop("fold", "label"), estimator, folds=2, step=2, components=0.9)
    assert [c for c in train.columns if c != "label"] == test.columns
    assert any(c.startswith("pca_") for c in test.columns)


def test_estimators_fit_into_a_spark_pipeline(data):
    stages = [features.MinMaxScaler(COLUMNS), models.ScoreClassifier("logistic_regression", COLUMNS)]
    assert "predicted" in Pipeline(stages=stages).fit(data).transform(data).columns
