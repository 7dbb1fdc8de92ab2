"""Comparisons of all pipelines: whole, and equal to fits one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import boosting, metrics, models, split, tune
from scoreloom.operators.boosting import Plan, Settings, grow

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    """Few distinct values a column, so that bins do not depend on the rows of a fold."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(500, 3)) * 4) / 4
    x[:9] = np.arange(-4, 5)[:, None]
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1]))).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(500)], "id long, label int, a double, b double, c double")
    return split.stratified_fold(df, "id", "label", 3).persist()


def test_all_registered_pipelines_are_compared(spark, data, monkeypatch):
    from scoreloom.catalog import learning

    monkeypatch.setattr(learning, "folded", lambda *a: data)
    monkeypatch.setattr(learning.tune, "compare", lambda df, estimators: estimators)
    found = learning.algos_compare(spark, "")
    assert set(found) == {*models.REGISTRY, "Stacking", "Blending"} and len(found) == 9
    for name, (kind, params) in models.REGISTRY.items():
        assert (found[name].kind, found[name].settings) == (kind, params)
    assert found["Stacking"].folds == 5 and [len(found[n].base) for n in ("Stacking", "Blending")] == [4, 5]


def test_folds_of_folds_are_those_of_the_other_rows(data):
    odd = data.withColumn("fold", F.when(F.col("id") % 40 != 0, F.col("fold")))
    found = split.folds_of_folds(odd, "id", "label", "fold", {0: "i0", 2: "i2"}, 4, 5).persist()
    for k in (0, 2):
        rest = odd.filter(F.col("fold") != k)
        want = {r["id"]: r["x"] for r in split.stratified_fold(rest, "id", "label", 4, 5, "x").collect()}
        got = {r["id"]: r[f"i{k}"] for r in found.collect()}
        assert len(got) == 500 and {i: v for i, v in got.items() if v >= 0} == want
    assert found.columns == [*odd.columns, "i0", "i2"]


def test_ensembles_without_a_fold_equal_fits_on_its_other_rows(data, monkeypatch):
    tree = models.ScoreClassifier("lightgbm", COLUMNS, params={"n_estimators": 3, "max_depth": 3, "learning_rate": 0.3, "min_child_samples": 5})
    line = models.ScoreClassifier("logistic_regression", COLUMNS)
    kinds = [models.Stacking([tree, line], folds=2), models.Blending([tree, line], use_features=True), models.Blending([tree], in_sample=True), tree]
    fits, fit = [], models.ScoreClassifier.fit_known
    monkeypatch.setattr(models.ScoreClassifier, "fit_known", lambda self, *a: fits.append(self) or fit(self, *a))
    together = models.fit_together(data, [(e, k) for e in kinds for k in (0, 2)], "fold")
    # Each fold: three lines of the stacking, one of the blending, three meta learners.
    assert len(fits) == 2 * (3 + 1 + 3)
    for k in (0, 2):
        part = data.filter(F.col("fold") == k)
        scored = models.add_scores(part, together[(0 if k == 0 else 1) :: 2], ["w", "x", "y", "z"]).orderBy("id").toPandas()
        assert list(scored.columns) == [*data.columns, "w", "x", "y", "z"]
        for e, name in zip(kinds, "wxyz"):
            alone = e.fit(data.filter(F.col("fold") != k)).transform(part).orderBy("id").toPandas()["score"]
            assert np.allclose(scored[name], alone, atol=1e-5), (k, name)


def test_shared_base_learners_are_fitted_once(data, monkeypatch):
    forest = {"n_estimators": 2, "max_depth": 3}
    one = models.ScoreClassifier("random_forest", COLUMNS, params=forest)
    again = models.ScoreClassifier("random_forest", COLUMNS, params=forest)
    fits, fit = [], models.ScoreClassifier.fit_known
    monkeypatch.setattr(models.ScoreClassifier, "fit_known", lambda self, *a: fits.append(self.kind) or fit(self, *a))
    out = tune.compare(data, {"forest": one, "both": models.Stacking([again], folds=2)}).collect()
    assert [(r["name"], r["folds"]) for r in out] == [("forest", 3), ("both", 3)]
    assert fits.count("random_forest") == 3 * 3 and fits.count("logistic_regression") == 3


def test_scores_keep_columns_of_the_same_name(data):
    named = data.withColumn("score_0", F.col("a"))
    model = models.Stacking([models.ScoreClassifier("lightgbm", COLUMNS, params={"n_estimators": 2, "max_depth": 2})], folds=2).fit(data)
    got = models.add_scores(named, [model], ["s"]).orderBy("id").toPandas()
    assert list(got.columns) == [*named.columns, "s"] and (got["score_0"] == got["a"]).all()
    assert np.allclose(got["s"], model.transform(data).orderBy("id").toPandas()["score"])


def test_meta_learner_reads_scores_that_are_stored(data, monkeypatch):
    plans, fit = [], models.ScoreClassifier._fit
    monkeypatch.setattr(models.ScoreClassifier, "_fit", lambda self, df: plans.append(df._jdf.queryExecution().toString()) or fit(self, df))
    base = [models.ScoreClassifier("lightgbm", COLUMNS, params={"n_estimators": n, "max_depth": 2}) for n in (1, 2)]
    for ensemble in (models.Stacking(base, folds=2), models.Blending(base)):
        assert metrics.auc_gini(ensemble.fit(data).transform(data)).first()["auc"] > 0.6
    assert len(plans) == 2 and not [p for p in plans if "EvalPython" in p]


def test_rows_of_many_folds_share_their_cells(data, monkeypatch):
    """Cells do not multiply by folds, nested folds and labels; passes over the tasks' blocks are not needed."""
    marked = data.withColumn("inner", (F.col("id") % 7).cast("int")).withColumn("late", F.col("id") % 11 == 0).repartition(4).persist()
    some = Settings(trees=4, depth=3, rate=0.3, min_rows=3)
    plans = [
        Plan([0], some, (0, None)), Plan([0], some, (1, 3)), Plan([0], Settings(trees=3, depth=4, bins=16, weights=(1.0, 4.0)), (2, 5)),
        Plan([0], Settings(trees=3, depth=2, rows_share=0.6), (None, 2)), Plan([0], some),
    ]
    x = np.linspace(-3, 3, 40)[:, None]
    small = grow(marked, ["c"], "label", plans, ["fold", "inner"], "late")
    kept, spread = [], boosting._Spread
    monkeypatch.setattr(boosting, "BROADCAST_BYTES", 3000)  # less than the rows; cells of one column are few
    monkeypatch.setattr(boosting, "_Spread", lambda blocks: kept.append(blocks) or spread(blocks))
    cells = grow(marked, ["c"], "label", plans, ["fold", "inner"], "late")
    assert len(kept) == 1  # only for the model that samples rows
    monkeypatch.setattr(boosting, "BROADCAST_BYTES", 0)
    passes = grow(marked, ["c"], "label", plans, ["fold", "inner"], "late")
    assert len(kept) == 4
    for plan, found in zip(plans, zip(small, cells, passes)):
        rows = marked
        for column, value in zip(("fold", "inner"), plan.fold or ()):
            rows = rows if value is None else rows.filter((F.col(column) != value) | F.col("late"))
        one, two, three = (next(m.margins(x, [9])) for m in found)
        assert np.allclose(one, two, atol=1e-9) and np.allclose(one, three, atol=1e-9)
        monkeypatch.setattr(boosting, "BROADCAST_BYTES", 1 << 24)
        if plan.settings.bins > 100:  # the bins of 16 are quantiles of all rows
            alone = grow(rows, ["c"], "label", [Plan([0], plan.settings)], None, "late")[0]
            assert np.allclose(next(alone.margins(x, [9])), one, atol=1e-9)


def test_cuts_found_for_a_few_nodes_at_a_time_are_the_same(data, monkeypatch):
    plan = [Plan([0, 1, 2], Settings(trees=2, depth=8))]
    whole = grow(data, COLUMNS, "label", plan)[0]
    monkeypatch.setattr(boosting._Grower, "_choose", _in_slices)
    assert grow(data, COLUMNS, "label", plan)[0].info() == whole.info()


def _in_slices(self, i, nodes, hist, columns):
    return [cut for n, node in enumerate(nodes) for cut in self._best_cuts(i, [node], hist[:, n : n + 1], columns)]
