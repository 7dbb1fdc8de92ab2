"""Boosted trees with gaps against plain versions, and many models grown together."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import boosting, metrics, models, tune
from scoreloom.operators.boosting import Boosted, Plan, Settings, Tree, bin_edges, grow

COLUMNS = ["a", "b", "c"]


def values(n=700, seed=4):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 3)) * 4) / 4
    y = (r.random(n) < 1 / (1 + np.exp(-1.5 * x[:, 0] + np.abs(x[:, 1])))).astype(int)
    x[r.random(n) < 0.25 + 0.3 * y, 0] = np.nan  # a gap tells something
    x[r.random(n) < 0.2, 1] = np.nan
    return x, y


@pytest.fixture(scope="module")
def data(spark):
    x, y = values()
    rows = [(i, int(y[i]), *[None if np.isnan(v) else float(v) for v in x[i]], i % 4, i % 5 == 0) for i in range(len(y))]
    return spark.createDataFrame(rows, "id long, label int, a double, b double, c double, fold int, valid boolean").repartition(5).persist()


def slow_tree(x, g, h, depth, penalty, least):
    """Every cut and both sides for the gaps, by loops over the rows; returns the value of every row."""
    out = np.zeros(len(x))

    def worth(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + penalty)

    def cut(rows, level):
        out[rows] = g[rows].sum() / (h[rows].sum() + penalty)
        if level == depth or len(rows) < 2 * least:
            return
        best = (1e-12, None, None)
        for f in range(x.shape[1]):
            v = x[rows, f]
            for edge in np.unique(v[~np.isnan(v)]):
                for gap_left in (True, False):
                    left = np.where(np.isnan(v), gap_left, v <= edge)
                    if left.sum() >= least and (~left).sum() >= least:
                        gain = worth(rows[left]) + worth(rows[~left]) - worth(rows)
                        if gain > best[0] + 1e-9:
                            best = (gain, rows[left], rows[~left])
        if best[1] is not None:
            cut(best[1], level + 1)
            cut(best[2], level + 1)

    cut(np.arange(len(x)), 0)
    return out


def slow_margins(x, y, s):
    start = math.log(y.mean() / (1 - y.mean()))
    margin = np.full(len(y), start)
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = ((y - p) / (p * (1 - p)), np.ones(len(y))) if s.natural else (y - p, p * (1 - p))
        move, scale = slow_tree(x, g, h, s.depth, s.penalty, s.min_rows), 1.0
        if s.natural:
            loss = lambda m: (np.logaddexp(0, m) - y * m).sum()
            while scale < 256 and loss(margin + 2 * scale * move) < loss(margin):
                scale *= 2
        margin = margin + s.rate * scale * move
    return margin


@pytest.mark.parametrize("kept", [16 << 20, 0])  # blocks broadcast, or spread over the tasks
@pytest.mark.parametrize(
    "settings", [Settings(trees=3, depth=3, rate=0.5, penalty=1.0, min_rows=20), Settings(trees=20, depth=1, rate=0.3), Settings(trees=4, depth=2, rate=0.1, natural=True, min_rows=5)]
)
def test_trees_match_a_search_over_all_cuts(data, settings, kept, monkeypatch):
    monkeypatch.setattr(boosting, "BROADCAST_BYTES", kept)
    monkeypatch.setattr(boosting, "PASS_CELLS", 300)
    x, y = values()
    model = grow(data, COLUMNS, "label", [Plan([0, 1, 2], settings)])[0]
    margin = next(model.margins(x, [settings.trees]))
    assert np.allclose(margin, slow_margins(x, y, settings), atol=1e-8)


def test_both_ways_of_growing_agree(data, monkeypatch):
    plans = [
        Plan([0, 1, 2], Settings(trees=20, depth=4, rows_share=0.7, tree_columns=0.67, level_columns=0.67, seed=3), 1),
        Plan([2, 0], Settings(trees=18, depth=2, weights=(1.0, 3.0)), 0), Plan([1], Settings(trees=5, depth=3, natural=True)),
    ]
    x, _ = values()
    found = []
    for kept in (16 << 20, 0):
        monkeypatch.setattr(boosting, "BROADCAST_BYTES", kept)
        together = grow(data, COLUMNS, "label", plans, "fold")
        found.append([next(m.margins(x[:, p.columns], [99])) for m, p in zip(together, plans)])
    for a, b in zip(*found):
        assert np.allclose(a, b, atol=1e-9)
    for i, plan in enumerate(plans):  # and each model is the one it would be by itself, without its fold
        rows = data if plan.fold is None else data.filter(F.col("fold") != plan.fold)
        edges = bin_edges(data, COLUMNS, 255)
        monkeypatch.setattr(boosting, "bin_edges", lambda *a, edges=edges: edges)
        alone = grow(rows, COLUMNS, "label", [Plan(plan.columns, plan.settings)])[0]
        assert np.allclose(next(alone.margins(x[:, plan.columns], [99])), found[0][i], atol=1e-9)


def test_large_frames_grow_over_counted_cells(data, monkeypatch):
    x, y = values()
    settings = Settings(trees=6, depth=2, rate=0.3, natural=True, min_rows=5)
    plans = [Plan([0], settings), Plan([0], Settings(trees=4, depth=2, weights=(1.0, 3.0)), 2)]
    alone = grow(data, ["c"], "label", plans, "fold")
    monkeypatch.setattr(boosting, "BROADCAST_BYTES", 15_000)  # 700 rows are larger than that, their cells are not

    def spread(blocks):
        raise AssertionError("passes over rows that are alike")

    monkeypatch.setattr(boosting, "_Spread", spread)
    found = grow(data, ["c"], "label", plans, "fold")
    for a, b in zip(alone, found):
        assert np.allclose(*[next(m.margins(x[:, [2]], [9])) for m in (a, b)], atol=1e-9)
    assert np.allclose(next(found[0].margins(x[:, [2]], [9])), slow_margins(x[:, [2]], y, settings), atol=1e-8)


def test_first_scales_settle_as_all_do():
    r = np.random.default_rng(1)
    for _ in range(300):
        losses = dict(zip((0.0, *boosting.SCALES), r.choice([0.0, 1.0, 2.0, math.nan], 1 + len(boosting.SCALES)).tolist()))
        scale = 1.0
        if losses[1.0] < losses[0.0]:
            while scale < 256 and losses[2 * scale] < losses[0.0]:
                scale *= 2
        else:
            while scale > 2.0**-8 and not losses[scale] < losses[0.0]:
                scale /= 2
        assert boosting._step_size(losses) == scale
        first = boosting._step_size({k: losses[k] for k in (0.0, 0.5, 1.0, 2.0)})
        assert first is None or first == scale


def test_gaps_go_where_they_help(data):
    model = models.registered("XGBoost", ["a"], n_estimators=1, max_depth=1, scale_pos_weight=1.0).fit(data)
    tree = model.model.trees[0]
    out = model.transform(data).groupBy(F.col("a").isNull().alias("gap")).agg(F.avg("score").alias("s"), F.avg("label").alias("y")).collect()
    assert tree.depth == 1 and {r.gap for r in out} == {True, False}
    gap = next(r for r in out if r.gap)
    assert gap.s == pytest.approx(model.transform(data).agg(F.min("score"), F.max("score")).first()[0 if gap.y < next(r for r in out if not r.gap).y else 1])


def test_quantile_edges_and_unseen_values(spark):
    rows = [(i, i % 2, float(i), None if i % 3 else float("nan")) for i in range(2000)] + [(9999, 1, float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double").repartition(4)
    edges = bin_edges(df, ["a", "b"], 32)
    assert 16 <= len(edges[0]) <= 32 and edges[0][-1] == 1999 and edges[1].tolist() == [1.0]
    model = models.ScoreClassifier("lightgbm", ["a", "b"], params={"n_estimators": 2, "max_bin": 32}).fit(df)
    new = spark.createDataFrame([(float("-inf"), None), (1e9, 5.0), (None, float("nan"))], "a double, b double")
    assert new.count() == len([r for r in model.transform(new).collect() if 0 < r.score < 1])


def test_early_stop_through_the_registry_and_ensembles(data):
    marked = data.withColumn("is_dev", F.col("fold") == 0)
    long = {"n_estimators": 200, "learning_rate": 1.0, "max_depth": 4, "min_child_samples": 1, "early_stopping_rounds": 5}
    model = models.registered("LightGBM", COLUMNS, validation="is_dev", **long).fit(marked)
    losses = [v for _, v in model.model.losses]
    assert len(model.model.trees) == max(1, int(np.argmin(losses))) and len(losses) < 60
    seen = marked.filter(~F.col("is_dev"))
    same = models.registered("LightGBM", COLUMNS, **{**long, "n_estimators": len(model.model.trees)}).fit(seen)
    pair = [m.transform(data).orderBy("id").select("score").toPandas().to_numpy() for m in (model, same)]
    assert np.allclose(*pair)
    ensemble = models.registered("Blending", COLUMNS, validation="is_dev")
    assert [b.validation for b in ensemble.base] == ["is_dev", "is_dev", "is_dev", None, "is_dev"]


def test_degenerate_frames(spark, data):
    one = models.ScoreClassifier("xgboost", COLUMNS, params={"n_estimators": 3}).fit(data.filter("label = 1"))
    assert one.transform(data).agg(F.min("score")).first()[0] > 0.99
    gaps = data.withColumn("a", F.lit(None).cast("double"))
    assert models.ScoreClassifier("xgboost", ["a"], params={"n_estimators": 3}).fit(gaps).importances() == [0.0]
    with pytest.raises(ValueError, match="rows have no label"):
        models.ScoreClassifier("xgboost", COLUMNS).fit(data.withColumn("label", F.when(F.col("id") > 3, F.col("label"))))


def test_saved_trees_score_alike():
    tree = Tree()
    left, right = tree.split(0, 1, 2.5, 3, False, (0.5, -0.25))
    tree.split(left, 0, -1.0, 0, True, (1.0, 2.0))
    tree.depth = 2
    model = Boosted(0.1, [tree], [1.0, 2.0])
    x = np.array([[0.0, 2.5], [-1.0, 2.0], [np.nan, 1.0], [0.0, 3.0], [0.0, np.nan]])
    again = Boosted.of(model.info())
    assert next(again.margins(x, [1])).tolist() == pytest.approx([2.1, 1.1, 1.1, -0.15, -0.15])


def test_cell_aucs_are_close_to_exact_ones(data):
    steps = [1, 3, 10]
    lists = [["a"], COLUMNS]
    train, dev = data.filter("fold <> 0"), data.filter("fold = 0")
    got = {(r["model"], r["iteration"]): r for r in tune.learning_curves(train, dev, lists, steps=steps, params={"learning_rate": 0.2}).collect()}
    assert set(got) == {(m, s) for m in (0, 1) for s in steps}
    for m, columns in enumerate(lists):
        for step in steps:
            model = models.ScoreClassifier("ngboost", columns, params={"learning_rate": 0.2, "n_estimators": step}).fit(train)
            for frame, name in ((train, "train_auc"), (dev, "dev_auc")):
                assert got[m, step][name] == pytest.approx(metrics.auc_gini(model.transform(frame)).first()["auc"], abs=2e-3)


def test_curves_apply_trees_once_to_rows_that_are_alike(spark):
    class Few(Boosted):
        def margins(self, x, steps):
            assert len(x) <= 4  # two sides of the cut, the gaps, beyond the last cut
            yield from Boosted.margins(self, x, steps)

    tree = Tree()
    tree.split(0, 0, 2.0, 1, False, (-1.0, 1.0))
    tree.depth = 1
    model = models.BoostedModel({"kind": "xgboost", "columns": ["a"], "label": "label"}, Few(0.0, [tree], [1.0]))
    rows = [(i % 2, i % 3 % 2 if i % 50 else None, None if i % 7 == 0 else float("nan") if i % 7 == 1 else i / 100) for i in range(1000)]
    marked = spark.createDataFrame(rows, "split int, label int, a double").repartition(3).filter("label is not null")
    got = {(r["split"], r["cell"]): (r["pos"], r["neg"]) for r in tune.staged_cells(marked, [model], [1]).collect()}
    for split in (0, 1):
        kept = [(y, a is not None and a <= 2) for s, y, a in rows if s == split and y is not None]
        for left in (False, True):
            cell = int(tune._score_cells(np.array([-1.0 if left else 1.0]))[0])
            assert got.pop((split, cell)) == (sum(y == 1 for y, at in kept if at == left), sum(y == 0 for y, at in kept if at == left))
    assert not got


def test_score_cells_keep_the_order():
    x = np.sort(np.concatenate([np.random.default_rng(0).normal(size=500), [0.0, -0.0, 1e-9, -1e-9, 30.0, -30.0]]))
    assert (np.diff(tune._score_cells(x)) >= 0).all()
