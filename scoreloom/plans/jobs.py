"""End-to-end jobs: preprocess a pair, preprocess per fold, train, predict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..base import TableEstimator
from ..operators.features import PCAFeatures
from ..operators.models import ScoreClassifier
from ..operators.select import select_features
from ..operators.split import stratified_fold
from ..session import store
from .recipe import CleaningRecipe, CleaningSpec, ExtractionRecipe, numeric_features


def preprocess(
    train: DataFrame,
    test: DataFrame,
    estimator: ScoreClassifier,
    id_col: str = "id",
    label: str = "label",
    folds: int = 5,
    step: int | float = 1,
    components: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Keep the selected features of a numeric pair; ``components`` adds principal components."""
    folded = stratified_fold(train, id_col, label, folds)
    chosen = select_features(folded, test, estimator, "fold", step)
    if components:
        pca = PCAFeatures(estimator.columns, components).fit(train)
        train, test = pca.transform(train), pca.transform(test)
    extra = [c for c in train.columns if c.startswith("pca_")] if components else []
    keep = [id_col, *chosen, *extra]
    return train.select(*keep, label), test.select(*keep)


def clean_and_extract(
    train: DataFrame, other: DataFrame, spec: CleaningSpec, columns: Sequence[str] | None = None, **limits
) -> tuple[DataFrame, DataFrame]:
    """Cleaning followed by WOE extraction, learned on ``train`` and applied to both."""
    cleaning = CleaningRecipe(spec, other).fit(train)
    # The cleaned training frame is read many times while the bins are learned.
    clean_train, clean_other = store(cleaning.transform(train)), cleaning.transform(other)
    skip = [spec.id_col, spec.label]
    features = columns or [
        c for c, t in clean_train.dtypes if c not in skip and not t.startswith("array")
    ]
    extraction = ExtractionRecipe(features, spec.label, spec.id_col, **limits).fit(clean_train)
    return extraction.transform_train(clean_train), extraction.transform(clean_other)


def clean_folds(
    df: DataFrame, spec: CleaningSpec, folds: int = 5, seed: int = 913100, **limits
) -> list[tuple[DataFrame, DataFrame]]:
    """``(train, dev)`` per fold, everything learned on the fold's training rows."""
    folded = stratified_fold(df, spec.id_col, spec.label, folds, seed, "_fold")
    pairs = []
    for k in range(folds):
        train = folded.filter(F.col("_fold") != k).drop("_fold")
        dev = folded.filter(F.col("_fold") == k).drop("_fold")
        pairs.append(clean_and_extract(train, dev, spec, **limits))
    return pairs


def train_and_score(
    train: DataFrame, test: DataFrame, estimator: TableEstimator, id_col: str = "id"
) -> DataFrame:
    """``id, score, predicted`` of the test rows."""
    return estimator.fit(train).transform(test).select(id_col, "score", "predicted")


def model_columns(df: DataFrame, id_col: str = "id", label: str = "label") -> list[str]:
    """Numeric columns that may enter a model."""
    return numeric_features(df, [id_col, label])
