"""Feature selection around a learner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cached
from .metrics import auc_gini
from .models import ScoreClassifier
from .tune import mean_aucs


def union_is_train(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both frames with ``is_train`` 1 / 0; columns of only one are NULL in the other."""
    return train.withColumn("is_train", F.lit(1)).unionByName(
        test.withColumn("is_train", F.lit(0)), allowMissingColumns=True
    )


def _path_table(df: DataFrame, path: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(path, "size int, mean_auc double, columns array<string>")


def rfe_cv(
    df: DataFrame, estimator: ScoreClassifier, fold: str = "fold", step: int | float = 1
) -> tuple[list[str], DataFrame]:
    """Recursive elimination scored by cross-validated AUC.

    Returns the columns of the best size (fewest on ties) and the path
    ``size, mean_auc, columns``.
    """
    columns, path = list(estimator.columns), []
    with cached(df) as frame:
        while True:
            current = estimator.on(columns)
            path.append((len(columns), mean_aucs(frame, [current], current.label, fold)[0], list(columns)))
            if len(columns) == 1:
                break
            importances = current.fit(frame).importances()
            drop = max(1, int(step * len(columns)) if isinstance(step, float) else step)
            weakest = sorted(range(len(columns)), key=lambda i: (importances[i], columns[i]))
            gone = set(weakest[: min(drop, len(columns) - 1)])
            columns = [c for i, c in enumerate(columns) if i not in gone]
    best = max(path, key=lambda p: (p[1], -p[0]))
    return best[2], _path_table(df, path)


class CovariateShift:
    """Which features tell train from test; keeps the ``share`` least telling ones."""

    def __init__(self, estimator: ScoreClassifier, share: float = 0.85):
        self.estimator, self.share = estimator, share

    def fit(self, train: DataFrame, test: DataFrame) -> CovariateShift:
        both = union_is_train(
            train.select(*[F.col(f"`{c}`") for c in self.estimator.columns]),
            test.select(*[F.col(f"`{c}`") for c in self.estimator.columns]),
        )
        learner = ScoreClassifier(
            self.estimator.kind, self.estimator.columns, "is_train", self.estimator.settings, seed=self.estimator.seed
        )
        model = learner.fit(both)
        self.auc = auc_gini(model.transform(both), label="is_train").first()["auc"]
        self.importances = model.importances()
        order = sorted(
            range(len(self.importances)), key=lambda i: (self.importances[i], learner.columns[i])
        )
        keep = set(order[: int(self.share * len(order))])
        self.selected = [c for i, c in enumerate(learner.columns) if i in keep]
        return self


def select_features(
    train: DataFrame, test: DataFrame, estimator: ScoreClassifier, fold: str = "fold", step: int | float = 1
) -> list[str]:
    """Columns kept by both recursive elimination and the covariate-shift check."""
    useful, _ = rfe_cv(train, estimator, fold, step)
    stable = CovariateShift(estimator).fit(train, test).selected
    return [c for c in estimator.columns if c in useful and c in stable]


def sequential_backward(
    df: DataFrame,
    estimator: ScoreClassifier,
    fold: str = "fold",
    smallest: int = 10,
    max_steps: int | None = None,
    parallelism: int = 2,
) -> tuple[list[str], DataFrame]:
    """Remove, one at a time, the column whose absence gives the best cross-validated AUC.

    Stops at ``smallest`` columns or after ``max_steps`` removals.  Returns the best set seen
    and the path ``size, mean_auc, columns``.
    """
    columns = list(estimator.columns)
    with cached(df) as frame:
        path = [(len(columns), mean_aucs(frame, [estimator], estimator.label, fold)[0], list(columns))]
        while len(columns) > max(1, smallest) and (max_steps is None or len(path) <= max_steps):
            trials = [[c for c in columns if c != gone] for gone in columns]
            scores = mean_aucs(frame, [estimator.on(t) for t in trials], estimator.label, fold, parallelism)
            best = max(range(len(trials)), key=lambda i: (scores[i], -i))
            columns = trials[best]
            path.append((len(columns), scores[best], list(columns)))
    chosen = max(path, key=lambda p: (p[1], -p[0]))
    return chosen[2], _path_table(df, path)
