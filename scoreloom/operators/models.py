"""Binary classifiers behind one contract: boosted trees of this library, the others from ``pyspark.ml``.

``ScoreClassifier(kind, ...)`` takes the parameter names people know from the usual libraries
and translates them; a parameter without a Spark counterpart is refused by name instead of
being ignored.  Every model adds ``score`` (probability of class 1) and ``predicted``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..base import TableEstimator, TableModel
from ..session import stored
from .boosting import Boosted, Plan, Settings, grow, score_array, score_column
from .features import MinMaxModel
from .split import folds_of_folds, hold_out, stratified_fold

# Known parameter names and the Spark parameters they stand for.
TRANSLATIONS = {
    "lightgbm": {
        "n_estimators": "trees",
        "max_depth": "depth",
        "learning_rate": "rate",
        "min_child_samples": "min_rows",
        "reg_lambda": "penalty",
        "subsample": "rows_share",
        "colsample_bytree": "tree_columns",
        "max_bin": "bins",
        "early_stopping_rounds": "patience",
    },
    "xgboost": {
        "n_estimators": "trees",
        "num_boost_round": "trees",
        "max_depth": "depth",
        "learning_rate": "rate",
        "eta": "rate",
        "reg_lambda": "penalty",
        "subsample": "rows_share",
        "colsample_bytree": "tree_columns",
        "colsample_bylevel": "level_columns",
        "max_bin": "bins",
        "early_stopping_rounds": "patience",
    },
    "catboost": {
        "iterations": "trees",
        "depth": "depth",
        "learning_rate": "rate",
        "l2_leaf_reg": "penalty",
        "subsample": "rows_share",
        "colsample_bylevel": "level_columns",
        "max_bin": "bins",
        "od_wait": "patience",
    },
    "ngboost": {
        "n_estimators": "trees",
        "max_depth": "depth",
        "learning_rate": "rate",
        "minibatch_frac": "rows_share",
        "early_stopping_rounds": "patience",
    },
    "random_forest": {
        "n_estimators": "numTrees",
        "criterion": "impurity",
        "max_features": "featureSubsetStrategy",
        "max_depth": "maxDepth",
        "min_samples_leaf": "minInstancesPerNode",
        "max_bin": "maxBins",
    },
    "logistic_regression": {
        "tol": "tol",
        "fit_intercept": "fitIntercept",
        "max_iter": "maxIter",
        "l1_ratio": "elasticNetParam",
    },
    "neural_network": {"epochs": "maxIter", "tol": "tol"},
}
#: Rows a task of a fit takes where the fits of many ensembles run side by side.
FIT_ROWS = 200_000
BOOSTED = {"lightgbm", "xgboost", "catboost", "ngboost"}
# Parameters that act on the training frame instead of the Spark estimator.
FRAME_PARAMETERS = {"class_weight", "scale_pos_weight", "C", "hidden", "random_state"}
# How the boosted learners grow trees where nothing else is said.
DEFAULTS = {
    "lightgbm": Settings(trees=100, depth=5, rate=0.1, min_rows=20),
    "xgboost": Settings(trees=100, depth=6, rate=0.3, penalty=1.0),
    "catboost": Settings(trees=1000, depth=6, rate=0.03, penalty=3.0, bins=254),
    "ngboost": Settings(trees=500, depth=3, rate=0.01, natural=True),
}
LEARNERS = {
    **dict.fromkeys(BOOSTED, (None, None)),
    "random_forest": (RandomForestClassifier, RandomForestClassificationModel),
    "logistic_regression": (LogisticRegression, LogisticRegressionModel),
    "neural_network": (MultilayerPerceptronClassifier, MultilayerPerceptronClassificationModel),
}


def translate(kind: str, params: dict) -> dict:
    """Spark parameters for a learner's own; unknown ones raise."""
    names = TRANSLATIONS[kind]
    unknown = [p for p in params if p not in names and p not in FRAME_PARAMETERS]
    if unknown:
        raise ValueError(f"{kind}: no counterpart for {', '.join(sorted(unknown))}")
    if kind == "neural_network" and {"class_weight", "scale_pos_weight"} & set(params):
        raise ValueError("neural_network: rows cannot be weighted")
    found = {names[p]: v for p, v in params.items() if p in names}
    if "featureSubsetStrategy" in found:
        share = found["featureSubsetStrategy"]
        if isinstance(share, int) and not isinstance(share, bool):
            found["featureSubsetStrategy"] = str(share)
        elif isinstance(share, float):
            found["featureSubsetStrategy"] = "all" if share >= 1 else repr(share)
    return found


class ScoreModel(TableModel):
    """Scales, assembles and scores; columns of the input stay untouched."""

    def __init__(self, info: dict, model=None):
        super().__init__(info)
        self.model = model

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.add_score(df, "score", "predicted")

    def add_score(self, df: DataFrame, out: str, predicted: str | None = None) -> DataFrame:
        """Add (or replace) the probability of class 1 and, if named, the predicted class."""
        names = [c for c in df.columns if c not in (out, predicted)]
        scored = self.model.transform(feature_vector(df, self.info["columns"], self.info["ranges"]))
        added = [vector_to_array(F.col("probability"))[1].alias(out)]
        if predicted:
            added.append(F.col("prediction").cast("int").alias(predicted))
        return scored.select(*[F.col(f"`{c}`") for c in names], *added)

    def importances(self) -> list[float]:
        return [float(x) for x in self.model.featureImportances.toArray()]

    def save(self, path: str) -> None:
        super().save(path)
        self.model.write().overwrite().save(f"{path}/model")

    @classmethod
    def load(cls, path: str) -> ScoreModel:
        spark = SparkSession.getActiveSession()
        info = json.loads(spark.read.text(f"{path}/meta").first()["value"])["info"]
        if info["kind"] in BOOSTED:
            return BoostedModel(info)
        return cls(info, LEARNERS[info["kind"]][1].load(f"{path}/model"))


class BoostedModel(ScoreModel):
    """Trees over the columns as they are: NULL and NaN follow the direction learned at each cut."""

    def __init__(self, info: dict, model: Boosted | None = None):
        super().__init__(info, model or Boosted.of(info["model"]))
        self.info["model"] = self.model.info()

    def add_score(self, df: DataFrame, out: str, predicted: str | None = None) -> DataFrame:
        names = [c for c in df.columns if c not in (out, predicted)]
        score = score_column(self.model, [F.col(f"`{c}`") for c in self.info["columns"]])
        scored = df.select(*[F.col(f"`{c}`") for c in names], score.alias(out))
        return scored.withColumn(predicted, (F.col(f"`{out}`") > 0.5).cast("int")) if predicted else scored

    def importances(self) -> list[float]:
        """Share of the gain of all cuts, per column."""
        total = sum(self.model.gains)
        return [g / total if total else 0.0 for g in self.model.gains]

    def save(self, path: str) -> None:
        TableModel.save(self, path)


def feature_vector(df: DataFrame, columns: Sequence[str], ranges: dict | None) -> DataFrame:
    names = [f"_f{i}" for i in range(len(columns))]
    df = df.withColumns({n: F.col(f"`{c}`").cast("double") for n, c in zip(names, columns)})
    if ranges:
        df = MinMaxModel({"ranges": {n: ranges[c] for n, c in zip(names, columns)}}).transform(df)
    return VectorAssembler(inputCols=names, outputCol="_features").transform(df).drop(*names)


class ScoreClassifier(TableEstimator):
    """Min-max scaling followed by one learner.

    ``validation`` names a boolean column whose rows decide when boosting stops early; they are not learned from.
    Boosted learners take NULL and NaN as they are; the others refuse them.
    """

    def __init__(
        self,
        kind: str,
        columns: Sequence[str],
        label: str = "label",
        params: dict | None = None,
        scale: bool = True,
        validation: str | None = None,
        seed: int = 0,
    ):
        super().__init__()
        if kind not in LEARNERS:
            raise ValueError(f"unknown learner {kind}; choose from {sorted(LEARNERS)}")
        self.kind, self.columns, self.label = kind, list(columns), label
        self.settings, self.scale, self.validation, self.seed = dict(params or {}), scale, validation, seed
        self.spark_params = translate(kind, self.settings)

    def on(self, columns: Sequence[str]) -> ScoreClassifier:
        """The same learner on other columns."""
        return ScoreClassifier(
            self.kind, columns, self.label, self.settings, self.scale, self.validation, self.seed
        )

    def key(self) -> tuple:
        """Equal for learners that learn the same from the same rows."""
        return self.kind, tuple(self.columns), self.label, json.dumps(self.settings, sort_keys=True), self.scale, self.validation, self.seed

    def class_sizes(self, df: DataFrame) -> dict:
        """Rows per class; rows without a label raise."""
        return row_facts(df, self.label).of(self)[0]

    def grower(self, sizes: dict) -> Settings:
        """How a boosted learner grows its trees."""
        weights = self._weights(sizes)
        found = {k: v for k, v in self.spark_params.items()}
        seed = self.settings.get("random_state", self.seed)
        return replace(DEFAULTS[self.kind], **found, seed=seed, weights=(float(weights.get(0, 1.0)), float(weights.get(1, 1.0))))

    def _fit(self, df: DataFrame) -> ScoreModel:
        if self.kind in BOOSTED:
            return fit_together(df, [(self, None)])[0]
        return self.fit_known(df, *row_facts(df, self.label, self.columns).of(self))

    def fit_known(self, df: DataFrame, sizes: dict, ranges: dict) -> ScoreModel:
        """The fit of a learner that is not boosted, on a frame whose class sizes and column ranges are known."""
        ranges = ranges if self.scale else None
        weights = self._weights(sizes)
        weight = F.lit(1.0)
        for value, w in weights.items():
            weight = F.when(F.col("_label") == value, F.lit(float(w))).otherwise(weight)
        frame = (
            feature_vector(df, self.columns, ranges)
            .select("_features", F.col(self.label).cast("double").alias("_label"))
            .withColumn("_weight", weight)
            .persist()
        )
        try:
            model = self._learner(sum(sizes.values()), bool(weights)).fit(frame)
        finally:
            frame.unpersist()
        info = {"kind": self.kind, "columns": self.columns, "label": self.label, "ranges": ranges}
        return ScoreModel(info, model)

    def _weights(self, sizes: dict) -> dict:
        if self.settings.get("class_weight") == "balanced":
            rows = sum(sizes.values())
            return {k: rows / (2 * n) for k, n in sizes.items()}
        if self.settings.get("scale_pos_weight"):
            return {1: self.settings["scale_pos_weight"]}
        return {}

    def _learner(self, rows: int, weighted: bool):
        learner, params = LEARNERS[self.kind][0], dict(self.spark_params)
        params.update(featuresCol="_features", labelCol="_label")
        if weighted:
            params["weightCol"] = "_weight"
        if self.kind == "logistic_regression":
            params["regParam"] = 1.0 / (self.settings.get("C", 1.0) * max(rows, 1))
            params["standardization"] = False
            return learner(**params)
        params["seed"] = self.settings.get("random_state", self.seed)
        if self.kind == "neural_network":
            hidden = list(self.settings.get("hidden", [16]))
            return learner(layers=[len(self.columns), *hidden, 2], **params)
        return learner(**params)


@dataclass
class RowFacts:
    """Per fold and class the number of rows, and the smallest and largest value of columns; with marks also per value of each."""

    columns: list[str]
    rows: list
    marks: list[str]

    def of(self, estimator: ScoreClassifier, without=None, mark: tuple | None = None) -> tuple[dict, dict]:
        """Class sizes and ranges of the estimator's columns in the rows of other folds (None: in all rows); rows without a label raise.

        ``mark``: a marking column and the value whose rows are left out as well.
        """
        rows = [r for r in self.rows if without is None or r["_fold"] is not None and r["_fold"] != without]
        if self.marks:
            at = self.marks.index(mark[0]) if mark else 0
            rows = [r for r in rows if r["_at"] == at and (mark is None or r["_mark"] != mark[1])]
        sizes: dict = {}
        for r in rows:
            sizes[r["_label"]] = sizes.get(r["_label"], 0) + r["_n"]
        if missing := sizes.pop(None, 0):
            raise ValueError(f"{missing} rows have no {estimator.label}; filter them before training")
        ranges = {}
        for i, c in enumerate(self.columns):
            if c in estimator.columns:
                ends = []
                for end, best in (("lo", min), ("hi", max)):
                    values = [r[f"{end}{i}"] for r in rows if r[f"{end}{i}"] is not None]
                    ends.append(best(values, key=lambda v: (v != v, v), default=None))  # NaN is the largest, as in Spark
                ranges[c] = ends
        return sizes, ranges


def row_facts(df: DataFrame, label: str, columns: Sequence[str] = (), fold: str | None = None, marks: Sequence[str] = ()) -> RowFacts:
    """What the fits on a frame and on its folds need to know of the rows beforehand, from one scan.

    ``marks`` are whole-numbered columns that cut the folds further, each by itself.
    """
    values = [(i, F.col(f"`{c}`").cast("double")) for i, c in enumerate(columns)]
    by = [F.col(f"`{label}`").alias("_label"), (F.col(fold) if fold else F.lit(0)).alias("_fold")]
    if marks:
        df = df.select(*[v.alias(f"v{i}") for i, v in values], *by, F.posexplode(F.array(*[F.col(m) for m in marks])).alias("_at", "_mark"))
        by, values = [F.col(c) for c in ("_label", "_fold", "_at", "_mark")], [(i, F.col(f"v{i}")) for i, _ in values]
    ends = [e for i, v in values for e in (F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"))]
    return RowFacts(list(columns), df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *ends).collect(), list(marks))


def fit_together(df: DataFrame, jobs: Sequence[tuple[TableEstimator, object]], fold: str | None = None, parallelism: int = 4) -> list[TableModel]:
    """Fit several learners on one frame, each without the rows of its own fold (None: on all rows).

    Boosted learners with the same label and validation rows grow side by side.  The others are fitted from a few threads, after one
    scan for the class sizes and ranges of all folds.  The base learners of ensembles that leave out a fold are fitted with the single
    ones, over the same frame, and those that learn from the same rows with the same settings only once.  Bin edges and the class sizes that
    weigh boosted learners are those of the whole frame.
    """
    nested = [e for e, k in jobs if isinstance(e, (Stacking, Blending)) and k is not None]
    if not nested:
        return _fit_parts(df, [(e, k, None) for e, k in jobs], fold, parallelism)
    marked, marks = _marked(df, jobs, fold)
    with stored(marked) as frame:  # tasks of the many fits then carry a short plan
        parts: dict[tuple, tuple] = {}
        wanted = []
        for i, (e, k) in enumerate(jobs):
            own = e.base_parts(k, marks.get((i, k))) if e in nested and k is not None else [(e, k, None)]
            keys = [(part[0].key() if isinstance(part[0], ScoreClassifier) else id(part[0]), *part[1:]) for part in own]
            parts.update({key: part for key, part in zip(keys, own) if key not in parts})
            wanted.append(keys)
        fitted = dict(zip(parts, _fit_parts(frame, list(parts.values()), fold, parallelism, sorted({m for m in marks.values() if m}))))

        def finish(i: int):
            (e, k), models = jobs[i], [fitted[key] for key in wanted[i]]
            if e not in nested or k is None:
                return models[0]
            return e.blend(frame.filter(F.col(fold) != k), models, marks.get((i, k)))

        return run_parallel([(lambda i=i: finish(i)) for i in range(len(jobs))], parallelism)


def _marked(df: DataFrame, jobs: Sequence[tuple], fold: str) -> tuple[DataFrame, dict]:
    """The frame with the columns that ensembles cut their rows by, and which of them the ensemble at a place among the jobs uses."""
    found: dict[tuple, str] = {}
    marks: dict[tuple, str | None] = {}
    stacked: dict[tuple, dict] = {}
    for i, (e, k) in enumerate(jobs):
        if isinstance(e, Stacking) and k is not None:
            outs = stacked.setdefault((e.id_col, e.label, e.folds, e.seed), {})
            marks[i, k] = outs.setdefault(k, f"_inner{len(stacked)}_{k}")
        elif isinstance(e, Blending) and k is not None:
            marks[i, k] = None if e.in_sample else found.setdefault((e.id_col, e.dev_size, e.seed), f"_dev{len(found)}")
    for (id_col, label, folds, seed), outs in stacked.items():
        df = folds_of_folds(df, id_col, label, fold, outs, folds, seed)
    for (id_col, share, seed), out in found.items():
        df = hold_out(df, id_col, share, seed, out).withColumn(out, F.col(out).cast("int"))
    return df, marks


def _fit_parts(df: DataFrame, jobs: Sequence[tuple], fold: str | None, parallelism: int, marks: Sequence[str] = ()) -> list[TableModel]:
    """Fit learners, each without the rows of a fold and without those that have a value of a marking column (None: with them)."""
    models: list = [None] * len(jobs)
    together: dict[tuple, list[int]] = {}
    alone = []
    for i, (estimator, _, _) in enumerate(jobs):
        if isinstance(estimator, ScoreClassifier) and estimator.kind in BOOSTED:
            together.setdefault((estimator.label, estimator.validation), []).append(i)
        else:
            alone.append(i)
    for (label, validation), found in together.items():
        columns = list(dict.fromkeys(c for i in found for c in jobs[i][0].columns))
        place = {c: n for n, c in enumerate(columns)}
        sizes = jobs[found[0]][0].class_sizes(df)
        plans = []
        for i in found:
            estimator, k, mark = jobs[i]
            left_out = (k, *[mark[1] if mark and mark[0] == m else None for m in marks])
            plans.append(Plan([place[c] for c in estimator.columns], estimator.grower(sizes), left_out if fold else None))
        for i, model in zip(found, grow(df, columns, label, plans, [fold, *marks] if fold else None, validation)):
            estimator = jobs[i][0]
            models[i] = BoostedModel({"kind": estimator.kind, "columns": estimator.columns, "label": label, "ranges": None}, model)
    single = [i for i in alone if isinstance(jobs[i][0], ScoreClassifier)]
    facts = {}
    for label in dict.fromkeys(jobs[i][0].label for i in single):
        columns = dict.fromkeys(c for i in single if jobs[i][0].label == label for c in jobs[i][0].columns)
        facts[label] = row_facts(df, label, list(columns), fold, marks)

    def fit(estimator, k, mark):
        rows = df if k is None else df.filter(F.col(fold) != k)
        rows = rows if mark is None else rows.filter(F.col(mark[0]) != mark[1])
        if not isinstance(estimator, ScoreClassifier):
            return estimator.fit(rows)
        sizes, ranges = facts[estimator.label].of(estimator, k, mark)
        if marks:  # many fits at once: their passes are cheap, starting tasks is not
            rows = rows.coalesce(max(1, math.ceil(sum(sizes.values()) / FIT_ROWS)))
        return estimator.fit_known(rows, sizes, ranges)

    rest = [(lambda job=jobs[i]: fit(*job)) for i in alone]
    for i, model in zip(alone, run_parallel(rest, parallelism)):
        models[i] = model
    return models


# Committed learner settings; sizes are meant to be overridden.
REGISTRY = {
    "LightGBM": ("lightgbm", {"n_estimators": 1, "max_depth": 12, "learning_rate": 0.01,
                              "min_child_samples": 100, "subsample": 1.0, "colsample_bytree": 0.65}),
    "CatBoost": ("catboost", {"iterations": 1, "depth": 10, "learning_rate": 0.01, "max_bin": 127,
                              "colsample_bylevel": 1.0}),
    "XGBoost": ("xgboost", {"n_estimators": 1, "max_depth": 10, "learning_rate": 0.01, "max_bin": 127,
                            "subsample": 1.0, "colsample_bylevel": 1.0, "scale_pos_weight": 60.7}),
    "NGBoost": ("ngboost", {"n_estimators": 1, "learning_rate": 0.01, "minibatch_frac": 0.68}),
    "NeuralNetwork": ("neural_network", {"hidden": [16], "epochs": 10}),
    "RandomForest": ("random_forest", {"n_estimators": 1, "criterion": "gini", "max_features": 1, "max_depth": 20,
                                       "min_samples_leaf": 10, "class_weight": "balanced"}),
    "LogisticRegression": ("logistic_regression", {"C": 0.5, "tol": 1e-4, "fit_intercept": True,
                                                   "max_iter": 100, "class_weight": "balanced"}),
}


def registered(name: str, columns: Sequence[str], label: str = "label", validation: str | None = None, **override):
    """A registered learner, or the stacking / blending of the registered ones.

    ``validation`` names the rows on which boosted learners stop early, also inside an ensemble.
    """
    if name == "Stacking":
        base = [registered(n, columns, label, validation) for n in ("LightGBM", "CatBoost", "XGBoost", "RandomForest")]
        return Stacking(base, label=label, **override)
    if name == "Blending":
        chosen = ("LightGBM", "CatBoost", "XGBoost", "RandomForest", "NGBoost")
        return Blending([registered(n, columns, label, validation) for n in chosen], label=label, **override)
    kind, params = REGISTRY[name]
    return ScoreClassifier(kind, columns, label, {**params, **override}, validation=validation if kind in BOOSTED else None)


def run_parallel(tasks: Sequence[Callable], parallelism: int) -> list:
    """Run independent driver-side fits from a few threads."""
    if parallelism <= 1 or len(tasks) <= 1:
        return [task() for task in tasks]
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        session = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        return pool.map(lambda task: inheritable_thread_target(session)(task)(), tasks, chunksize=1)


class EnsembleModel(TableModel):
    """Base scores as columns, then the meta learner."""

    def __init__(self, info: dict, base: list, meta: ScoreModel):
        super().__init__(info)
        self.base, self.meta = base, meta

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.add_score(df, "score", "predicted")

    def add_score(self, df: DataFrame, out: str, predicted: str | None = None) -> DataFrame:
        """Add (or replace) the meta learner's probability of class 1 and, if named, the predicted class."""
        names = [c for c in df.columns if c not in (out, predicted)]
        scored = self.meta.add_score(base_scores(df, self.base), out, predicted)
        return scored.select(*[F.col(f"`{c}`") for c in names], *[F.col(f"`{c}`") for c in (out, predicted) if c])

    def save(self, path: str) -> None:
        super().save(path)
        for i, model in enumerate([*self.base, self.meta]):
            model.save(f"{path}/part{i}")

    @classmethod
    def load(cls, path: str) -> EnsembleModel:
        spark = SparkSession.getActiveSession()
        info = json.loads(spark.read.text(f"{path}/meta").first()["value"])["info"]
        parts = [ScoreModel.load(f"{path}/part{i}") for i in range(info["size"] + 1)]
        return cls(info, parts[:-1], parts[-1])


def base_scores(df: DataFrame, models: Sequence[ScoreModel], names: Sequence[str] | None = None) -> DataFrame:
    """Add ``score_0, score_1, ...`` (or ``names``) of several models in one pass, those of all boosted ones in one go."""
    names = names or [f"score_{i}" for i in range(len(models))]
    boosted = [i for i, model in enumerate(models) if isinstance(model, BoostedModel)]
    if len(boosted) > 1:
        columns = list(dict.fromkeys(c for i in boosted for c in models[i].info["columns"]))
        places = [[columns.index(c) for c in models[i].info["columns"]] for i in boosted]
        df = df.withColumn("_boosted", score_array([models[i].model for i in boosted], places, [F.col(f"`{c}`") for c in columns]))
        df = df.withColumns({names[i]: F.col("_boosted")[n] for n, i in enumerate(boosted)}).drop("_boosted")
    for i, model in enumerate(models):
        if len(boosted) < 2 or i not in boosted:
            df = model.add_score(df, names[i])
    return df


def add_scores(df: DataFrame, models: Sequence[TableModel], names: Sequence[str]) -> DataFrame:
    """Add the scores of several models of any kind; a base learner that several ensembles share scores the rows once."""
    singles: dict[int, TableModel] = {}
    for model in models:
        singles.update({id(m): m for m in (model.base if isinstance(model, EnsembleModel) else [model])})
    place = {key: f"_single{i}" for i, key in enumerate(singles)}
    kept = df.columns
    df = base_scores(df, list(singles.values()), list(place.values()))
    for model, name in zip(models, names):
        if isinstance(model, EnsembleModel):
            have = df.columns
            hidden = {f"score_{i}": F.col(place[id(m)]) for i, m in enumerate(model.base)}
            kept_aside = {f"_own_{c}": F.col(f"`{c}`") for c in hidden if c in have}
            df = model.meta.add_score(df.withColumns(kept_aside).withColumns(hidden), name)
            df = df.withColumns({c: F.col(f"_own_{c}") for c in hidden if c in have}).drop(*kept_aside, *[c for c in hidden if c not in have])
        else:
            df = df.withColumn(name, F.col(place[id(model)]))
    return df.select(*[F.col(f"`{c}`") for c in kept if c not in names], *names)


def _fit_meta(meta: ScoreClassifier, scored: DataFrame) -> ScoreModel:
    """The meta learner's fit; the base learners score each row once, and its tasks do not carry their models."""
    with stored(scored.select(*[F.col(f"`{c}`") for c in (meta.label, *meta.columns)])) as rows:
        return meta.fit(rows)


def _meta(size: int, label: str, features: Sequence[str], params: dict | None) -> ScoreClassifier:
    columns = [*features, *[f"score_{i}" for i in range(size)]]
    return ScoreClassifier(
        "logistic_regression", columns, label, params or REGISTRY["LogisticRegression"][1], scale=False
    )


class Stacking(TableEstimator):
    """Out-of-fold base scores train the meta learner; base learners are refitted on all rows.

    One pass per fold scores the held-out rows with all base models, so no score columns have
    to be joined.
    """

    def __init__(
        self,
        base: Sequence[ScoreClassifier],
        label: str = "label",
        id_col: str = "id",
        folds: int = 5,
        seed: int = 0,
        meta_params: dict | None = None,
        parallelism: int = 4,
    ):
        super().__init__()
        self.base, self.label, self.id_col = list(base), label, id_col
        self.folds, self.seed, self.meta_params = folds, seed, meta_params
        self.parallelism = parallelism

    def _fit(self, df: DataFrame) -> EnsembleModel:
        folded = stratified_fold(df, self.id_col, self.label, self.folds, self.seed, "_fold").persist()
        jobs = [(b, k) for k in [*range(self.folds), None] for b in self.base]
        try:
            return self.blend(folded, fit_together(folded, jobs, "_fold", self.parallelism), "_fold")
        finally:
            folded.unpersist()

    def base_parts(self, k, mark: str) -> list[tuple]:
        """Base learners without fold ``k``: those without a fold of the other rows too, then those of all the others."""
        return [(b, k, None if i is None else (mark, i)) for i in [*range(self.folds), None] for b in self.base]

    def blend(self, rows: DataFrame, models: Sequence[ScoreModel], mark: str) -> EnsembleModel:
        """The ensemble of fitted base learners, in the order of :meth:`base_parts`; ``mark`` is the column of folds."""
        size, out = len(self.base), None
        for k in range(self.folds):
            part = base_scores(rows.filter(F.col(mark) == k), models[k * size : (k + 1) * size])
            out = part if out is None else out.unionByName(part)
        meta = _fit_meta(_meta(size, self.label, [], self.meta_params), out)
        return EnsembleModel({"size": size}, models[self.folds * size :], meta)


class Blending(TableEstimator):
    """Base learners on one part of the rows, the meta learner on their scores for the rest.

    ``in_sample`` trains both on all rows; ``use_features`` also passes the features on.
    """

    def __init__(
        self,
        base: Sequence[ScoreClassifier],
        label: str = "label",
        id_col: str = "id",
        dev_size: float = 0.2,
        in_sample: bool = False,
        use_features: bool = False,
        seed: int = 0,
        meta_params: dict | None = None,
        parallelism: int = 4,
    ):
        super().__init__()
        self.base, self.label, self.id_col = list(base), label, id_col
        self.dev_size, self.in_sample, self.use_features = dev_size, in_sample, use_features
        self.seed, self.meta_params, self.parallelism = seed, meta_params, parallelism

    def _fit(self, df: DataFrame) -> EnsembleModel:
        if self.in_sample:
            train = dev = df
        else:
            marked = hold_out(df, self.id_col, self.dev_size, self.seed, "_dev")
            train, dev = marked.filter(~F.col("_dev")), marked.filter(F.col("_dev"))
        return self._blended(dev, fit_together(train, [(b, None) for b in self.base], None, self.parallelism))

    def base_parts(self, k, mark: str | None) -> list[tuple]:
        """Base learners without fold ``k`` and, unless they learn in sample, without the marked rows."""
        return [(b, k, None if mark is None else (mark, 1)) for b in self.base]

    def blend(self, rows: DataFrame, models: Sequence[ScoreModel], mark: str | None) -> EnsembleModel:
        """The ensemble of fitted base learners; the meta learner learns from the marked rows."""
        return self._blended(rows if mark is None else rows.filter(F.col(mark) == 1), models)

    def _blended(self, dev: DataFrame, models: Sequence[ScoreModel]) -> EnsembleModel:
        features = self.base[0].columns if self.use_features else []
        meta = _meta(len(models), self.label, features, self.meta_params)
        return EnsembleModel({"size": len(models)}, models, _fit_meta(meta, base_scores(dev, models)))


def importance_table(spark: SparkSession, columns: Sequence[str], importances: Sequence[float]) -> DataFrame:
    """Features by falling importance, name on ties."""
    rows = [(c, float(v)) for c, v in zip(columns, importances)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )
