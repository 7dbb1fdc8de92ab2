"""Cross-validation, grid search, learning curves and comparisons."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from itertools import product
from statistics import fmean, pstdev

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..base import TableEstimator
from ..functions.missing import quoted
from ..session import cached, store
from .boosting import Boosted, column_matrix, distinct_rows
from .encode import FrequencyEncoder, LabelEncoder, MeanEncoder, OneHotEncoder
from .metrics import auc_gini
from .models import TRANSLATIONS, BoostedModel, ScoreClassifier, add_scores, fit_together

#: Low bits of a score's float that its cell leaves out, and the counters a task keeps.
CELL_BITS, CELL_ROWS = 11, 500_000


def out_of_fold(
    df: DataFrame,
    estimator: TableEstimator,
    label: str = "label",
    fold: str = "fold",
    folds: Sequence[int] | None = None,
    with_train: bool = False,
    parallelism: int = 4,
) -> DataFrame:
    """``fold, split, label, score``: every fold scored by the model fitted on the other folds."""
    if folds is None:
        folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    models = fit_together(df, [(estimator, k) for k in folds], fold, parallelism)
    return fold_scores(df, models, folds, label, fold, with_train)


def fold_scores(df: DataFrame, models: Sequence, folds: Sequence, label: str, fold: str, with_train: bool = False) -> DataFrame:
    """``fold, split, label, score`` of the rows that each fold's model has not, or with ``with_train`` also has, learned from."""
    out = None
    for k, model in zip(folds, models):
        for split in ("train", "dev") if with_train else ("dev",):
            rows = df.filter(F.col(fold) == k if split == "dev" else F.col(fold) != k)
            part = model.transform(rows).select(
                F.lit(k).alias("fold"), F.lit(split).alias("split"), F.col(label).alias("label"), "score"
            )
            out = part if out is None else out.unionByName(part)
    return out


def cross_validate(df: DataFrame, estimator: TableEstimator, label: str = "label", fold: str = "fold", **how):
    """AUC and Gini per fold and split, all folds measured in one job."""
    scores = out_of_fold(df, estimator, label, fold, with_train=True, **how)
    return auc_gini(scores, by=["fold", "split"])


def fold_aucs(df: DataFrame, estimators: Sequence[TableEstimator], label: str = "label", fold: str = "fold", parallelism: int = 4) -> list[list[float]]:
    """Development AUC of every fold that has both classes, per estimator; all are fitted and measured together."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    models = fit_together(df, [(e, k) for e in estimators for k in folds], fold, parallelism)
    scores = None
    for i, k in enumerate(folds):
        part, names = df.filter(F.col(fold) == k), [f"_by_{e}" for e in range(len(estimators))]
        part = add_scores(part, models[i :: len(folds)], names)
        pairs = F.posexplode(F.array(*names)).alias("estimator", "score")
        part = part.select(F.lit(k).alias("fold"), F.col(label).alias("label"), pairs)
        scores = part if scores is None else scores.unionByName(part)
    found: list[list[float]] = [[] for _ in estimators]
    if scores is not None:
        for r in sorted(auc_gini(scores, by=["estimator", "fold"]).collect(), key=lambda r: (r["estimator"], r["fold"])):
            if r["auc"] is not None:
                found[r["estimator"]].append(r["auc"])
    return found


def mean_aucs(df: DataFrame, estimators: Sequence[TableEstimator], label: str = "label", fold: str = "fold", parallelism: int = 4) -> list[float]:
    """Mean development AUC per estimator; without a fold that has both classes there is none."""
    found = fold_aucs(df, estimators, label, fold, parallelism)
    if not all(found):
        raise ValueError("no fold holds both classes")
    return [fmean(x) for x in found]


def compare(df: DataFrame, estimators: Mapping[str, TableEstimator], label: str = "label", fold: str = "fold"):
    """Mean and deviation of the fold AUCs per named estimator.  The frame is read once."""
    with cached(df) as frame:
        found = fold_aucs(frame, list(estimators.values()), label, fold)
    if not all(found):
        raise ValueError("no fold holds both classes")
    rows = [(name, fmean(x), pstdev(x), len(x)) for name, x in zip(estimators, found)]
    return df.sparkSession.createDataFrame(
        rows, "name string, mean_auc double, std_auc double, folds int"
    )


def grid_search(
    df: DataFrame,
    kind: str,
    columns: Sequence[str],
    grid: Mapping[str, Sequence],
    label: str = "label",
    fold: str = "fold",
    fixed: Mapping | None = None,
) -> DataFrame:
    """Mean fold AUC of every combination: ``run, params map, mean_auc, std_auc``, best first."""
    combos = [dict(zip(grid, values)) for values in product(*grid.values())]
    estimators = {
        str(i): ScoreClassifier(kind, columns, label, {**(fixed or {}), **c}) for i, c in enumerate(combos)
    }
    text = [(str(i), {k: str(v) for k, v in c.items()}) for i, c in enumerate(combos)]
    params = df.sparkSession.createDataFrame(text, "name string, params map<string,string>")
    return (
        compare(df, estimators, label, fold)
        .join(F.broadcast(params), "name")
        .select(F.col("name").cast("int").alias("run"), "params", "mean_auc", "std_auc")
        .orderBy(F.desc("mean_auc"), "run")
    )


def log_steps(last: int = 500, points: int = 50) -> list[int]:
    """Distinct whole numbers from 1 to ``last``, evenly spaced on a log scale."""
    return sorted({int(last ** (i / (points - 1)) + 1e-9) for i in range(points)})


def staged_scores(df: DataFrame, model: BoostedModel, steps: Sequence[int]) -> DataFrame:
    """Positive-class scores after the first ``steps`` trees, as an array in ``scores``; every tree is applied once."""
    boosted, steps = model.model, list(steps)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            x = column_matrix(batch)
            margins = np.column_stack(list(boosted.margins(x, steps)))
            yield pd.Series(list(1 / (1 + np.exp(-margins))))

    columns = [F.col(f"`{c}`").cast("double") for c in model.info["columns"]]
    return df.select(*[F.col(f"`{c}`") for c in df.columns], score(*columns).alias("scores"))


def _score_cells(margin: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the scores; scores share one only if they agree to about one part in 4,000."""
    bits = margin.astype(np.float32).view(np.int32).astype(np.int64)
    return np.where(bits < 0, -(bits & 0x7FFFFFFF), bits) >> CELL_BITS


def _cut_points(model: Boosted, columns: int) -> list[np.ndarray]:
    """Per column the ascending cuts of all trees."""
    found: list[set] = [set() for _ in range(columns)]
    for tree in model.trees:
        for f, cut in zip(tree.feature, tree.cut):
            if f >= 0:
                found[f].add(cut)
    return [np.array(sorted(f)) for f in found]


def staged_cells(marked: DataFrame, models: Sequence[BoostedModel], steps: Sequence[int]) -> DataFrame:
    """``model, split, iteration, cell, pos, neg``: rows of ``split, label`` and the models' columns counted in cells of their score.

    Rows between the same cuts of a model have the same scores.  They are counted first, and its trees are applied once to every such kind
    of row.  A task then keeps counters for every model and number of trees, and hands them on when they are many.
    """
    columns = list(dict.fromkeys(c for m in models for c in m.info["columns"]))
    place = {c: i for i, c in enumerate(columns)}
    parts = [(m.model, [place[c] for c in m.info["columns"]], [s for s in steps if s <= len(m.model.trees)]) for m in models]
    cuts = [_cut_points(boosted, len(own)) for boosted, own, _ in parts]
    names = [f"c{i}" for i in range(len(columns))]
    counts = ["neg0", "pos0", "neg1", "pos1"]  # by split and label

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, group = batch[names].to_numpy(float), 2 * (batch["split"].to_numpy() == 1) + (batch["label"].to_numpy() == 1)
            for number, ((_, own, _), points) in enumerate(zip(parts, cuts)):
                places = np.zeros((len(x), len(own)), np.int32)
                for i, (c, p) in enumerate(zip(own, points)):
                    if len(p):
                        places[:, i] = np.where(np.isnan(x[:, c]), len(p) + 1, np.searchsorted(p, x[:, c]))
                kinds, at = distinct_rows(places.view(np.uint8))
                found = np.bincount(at * 4 + group, minlength=4 * len(kinds)).reshape(-1, 4)
                yield pd.DataFrame({"model": number, "kind": [k.tobytes() for k in kinds], **dict(zip(counts, found.T))})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, size = [], 0
        for batch in batches:
            for number, rows in batch.groupby("model"):
                (boosted, own, wanted), points = parts[number], cuts[number]
                places = np.frombuffer(b"".join(rows["kind"]), np.int32).reshape(len(rows), len(own))
                x = np.column_stack([np.append(p, [np.inf, np.nan])[places[:, i]] for i, p in enumerate(points)])
                number_of = rows[counts].to_numpy(float).reshape(-1, 2, 2)
                for step, margin in zip(wanted, boosted.margins(x, wanted)):
                    for side in (0, 1):
                        here = number_of[:, side].any(axis=1)
                        cells, at = np.unique(_score_cells(margin[here]), return_inverse=True)
                        neg, pos = (np.bincount(at, number_of[here, side, y], len(cells)).astype(np.int64) for y in (0, 1))
                        waiting.append(pd.DataFrame({"model": number, "split": side, "iteration": step, "cell": cells, "pos": pos, "neg": neg}))
                        size += len(cells)
            if size > CELL_ROWS:
                yield _summed(waiting)
                waiting, size = [], 0
        if waiting:
            yield _summed(waiting)

    rows = marked.select("split", F.col("label").cast("int").alias("label"), *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(columns, names)])
    kinds = rows.mapInPandas(alike, "model int, kind binary, neg0 long, pos0 long, neg1 long, pos1 long")
    kinds = kinds.groupBy("model", "kind").agg(*[F.sum(c).alias(c) for c in counts])
    keys = ("model", "split", "iteration", "cell")
    scored = kinds.mapInPandas(count, "model int, split int, iteration int, cell long, pos long, neg long")
    return scored.groupBy(*keys).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _summed(parts: list[pd.DataFrame]) -> pd.DataFrame:
    keys = ["model", "split", "iteration", "cell"]
    return pd.concat(parts).groupby(keys, as_index=False)[["pos", "neg"]].sum()


def cell_aucs(cells: DataFrame) -> DataFrame:
    """``model, iteration, train_auc, dev_auc`` from counts per cell; pairs inside a cell count half."""
    order = Window.partitionBy("model", "split", "iteration").orderBy("cell")
    above = F.sum("neg").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("neg") / 2.0
    sums = cells.withColumn("pairs", F.col("pos") * above).groupBy("model", "split", "iteration")
    aucs = sums.agg(F.try_divide(F.sum("pairs"), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))
    return aucs.groupBy("model", "iteration").agg(
        F.max(F.when(F.col("split") == 0, F.col("auc"))).alias("train_auc"), F.max(F.when(F.col("split") == 1, F.col("auc"))).alias("dev_auc")
    )


def learning_curves(
    train: DataFrame,
    dev: DataFrame,
    columns: Sequence[Sequence[str]],
    label: str = "label",
    steps: Sequence[int] | None = None,
    params: Mapping | None = None,
    kind: str = "ngboost",
) -> DataFrame:
    """Curves of one learner over several lists of columns: ``model, iteration, train_auc, dev_auc``.

    The models grow side by side with the largest number of trees; smaller numbers are their prefixes.  AUC is taken from cells of
    nearly equal scores, so its error is below half the share of pairs whose scores agree to one part in 4,000.
    """
    steps = sorted(steps or log_steps())
    count = next(p for p, name in TRANSLATIONS[kind].items() if name == "trees")
    jobs = [(ScoreClassifier(kind, c, label, {**(params or {}), count: steps[-1]}), None) for c in columns]
    models = fit_together(train, jobs)
    every = [F.col(f"`{c}`") for c in dict.fromkeys(c for names in columns for c in names)]
    marked = train.select(F.lit(0).alias("split"), F.col(label).alias("label"), *every).unionByName(
        dev.select(F.lit(1).alias("split"), F.col(label).alias("label"), *every)
    )
    return cell_aucs(staged_cells(marked.filter("label is not null"), models, steps))


def learning_curve(train: DataFrame, dev: DataFrame, columns: Sequence[str], *args, **how) -> DataFrame:
    """AUC on both frames per number of trees: ``iteration, train_auc, dev_auc``; see :func:`learning_curves`."""
    return learning_curves(train, dev, [columns], *args, **how).drop("model")


def best_iteration(curve: DataFrame) -> dict:
    """First iteration with the best development AUC, and the best training AUC up to it."""
    return _best(curve.collect())


def _best(rows: Sequence) -> dict:
    best = max(rows, key=lambda r: (-math.inf if r["dev_auc"] is None else r["dev_auc"], -r["iteration"]))
    until = [r["train_auc"] for r in rows if r["iteration"] <= best["iteration"]]
    return {
        "train_auc": max(until),
        "best_auc": best["dev_auc"],
        "best_iteration": best["iteration"],
    }


def encoder_comparison(
    train: DataFrame,
    dev: DataFrame,
    columns: Sequence[str],
    label: str,
    id_col: str,
    steps: Sequence[int] | None = None,
    params: Mapping | None = None,
) -> DataFrame:
    """Learning curves of eight encodings of the same columns, best point of each.

    All encodings stand side by side in one frame, and their models grow together.
    """
    # The compared settings and their names.
    settings = {
        "One hot encoding": OneHotEncoder(columns, id_col),
        "Label encoding": LabelEncoder(columns, id_col),
        "Frequency encoding": FrequencyEncoder(columns),
        "Mean encoding, alpha=0": MeanEncoder(columns, label, 0, None, id_col),
        "Mean encoding, alpha=2": MeanEncoder(columns, label, 2, None, id_col),
        "Mean encoding, alpha=5": MeanEncoder(columns, label, 5, None, id_col),
        "Mean encoding, alpha=5, 3 folds": MeanEncoder(columns, label, 5, 3, id_col),
        "Mean encoding, alpha=5, 5 folds": MeanEncoder(columns, label, 5, 5, id_col),
    }
    one, two, lists = train, dev, []
    for number, encoder in enumerate(settings.values()):
        model = encoder.fit(train)
        coded = model.transform_train(one) if hasattr(model, "transform_train") else model.transform(one)
        added = [c for c in coded.columns if c not in one.columns]
        # Category names may hold dots or quotes, and encodings share names; plain names are used from here on.
        names = [f"e{number}_{i}" for i in range(len(added))]
        plain = [F.col(quoted(c)).alias(n) for c, n in zip(added, names)]
        two = model.transform(two).select(*[F.col(quoted(c)) for c in two.columns], *plain)
        one = coded.select(*[F.col(quoted(c)) for c in one.columns], *plain)
        lists.append(names)
    wanted = [c for names in lists for c in names]
    one, two = store(one.select(label, *wanted)), store(two.select(label, *wanted))
    curves = learning_curves(one, two, lists, label, steps, params).collect()
    rows = []
    for number, name in enumerate(settings):
        best = _best([r for r in curves if r["model"] == number])
        rows.append((name, best["train_auc"], best["best_auc"], best["best_iteration"]))
    return train.sparkSession.createDataFrame(
        rows, "encoding string, train_auc double, best_auc double, best_iteration int"
    )
