"""Ranking and probability metrics as aggregations.

Scores are grouped to one row per distinct value before anything is ordered; the running
counts use the two-level prefix sums of :mod:`.ordering`.  ``by`` columns (fold, split,
iteration ...) give all groups in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ordering import column_stats, running_totals


def score_counts(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: ``pos, neg``, running counts from the top score, group totals.

    Scoring may be expensive, so the counts are materialised: the rows are scored once.
    """
    cells = materialize(
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("threshold"))
        .agg(
            F.sum(F.col(label).cast("long")).alias("pos"),
            F.sum(1 - F.col(label).cast("long")).alias("neg"),
        )
    )
    points = column_stats(cells, ["threshold"]).points("threshold")
    return running_totals(cells, "threshold", ["pos", "neg"], points, by=by, descending=True)


def auc_gini(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve with ties counted half, and ``gini = 2 auc - 1``.

    NULL when a class is absent.
    """
    counts = score_counts(df, score, label, by)
    pairs = F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") / 2.0)
    grouped = counts.groupBy(*by).agg(
        F.sum(pairs).alias("_pairs"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )
    auc = F.try_divide(F.col("_pairs"), F.col("n_pos").cast("double") * F.col("n_neg"))
    return grouped.select(*by, "n_pos", "n_neg", auc.alias("auc"), (2 * auc - 1).alias("gini"))


def cross_validated_auc(df: DataFrame, score: str = "score", label: str = "label", by: str = "fold"):
    """Mean and population deviation of the per-fold AUC and Gini."""
    return auc_gini(df, score, label, [by]).agg(
        F.avg("auc").alias("mean_auc"),
        F.stddev_pop("auc").alias("std_auc"),
        F.avg("gini").alias("mean_gini"),
        F.count("auc").alias("folds"),
    )


def auc_train_dev(
    df: DataFrame, scores: Sequence[str], label: str = "label", fold: str = "fold"
) -> DataFrame:
    """AUC and Gini of every fold's model on its training and on its held-out rows.

    ``scores[k]`` is the score by the model that did not see fold ``k``.  Rows are counted per model, part
    and score before anything is ordered; all curves come from one job.  Result: ``fold, part`` (``train`` or
    ``dev``), and the columns of :func:`auc_gini`.
    """
    pairs = [x for k, c in enumerate(scores) for x in (F.lit(k), F.col(f"`{c}`").cast("double"))]
    stacked = df.select(
        F.col(f"`{fold}`").alias("_held"),
        F.col(f"`{label}`").alias("label"),
        F.stack(F.lit(len(scores)), *pairs).alias("fold", "score"),
    )
    part = F.when(F.col("_held") == F.col("fold"), "dev").otherwise("train")
    return auc_gini(stacked.withColumn("part", part), by=["fold", "part"])


def roc_points(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """``threshold, fpr, tpr`` for every distinct score, and the origin with a NULL threshold."""
    counts = score_counts(df, score, label, by)
    points = counts.select(
        *by,
        "threshold",
        F.try_divide(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
        F.try_divide(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
    )
    groups = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    origin = groups.select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return points.unionByName(origin)


def mean_roc(
    df: DataFrame, score: str = "score", label: str = "label", by: str = "fold", points: int = 100
) -> DataFrame:
    """Mean of the groups' ROC curves on an even FPR grid: ``step, fpr, mean_tpr``.

    Each step between neighbouring scores knows which grid points it covers (integer
    arithmetic on its own counts), so interpolation needs no join.
    """
    counts = score_counts(df, score, label, [by])
    last = points - 1
    negatives = F.col("all_neg")

    def first_step(count):
        return F.floor((last * count + negatives - 1) / negatives).cast("long")

    before_neg, before_pos = F.col("cum_neg") - F.col("neg"), F.col("cum_pos") - F.col("pos")
    covered = F.sequence(first_step(before_neg), first_step(F.col("cum_neg")) - 1)
    steps = (
        counts.filter((F.col("neg") > 0) & (F.col("all_pos") > 0))
        .filter(first_step(before_neg) < first_step(F.col("cum_neg")))
        .withColumn("step", F.explode(covered))
    )
    share = (F.col("step") * negatives / last - before_neg) / F.col("neg")
    tpr = (before_pos + share * F.col("pos")) / F.col("all_pos")
    tpr = F.when(F.col("step") == 0, F.lit(0.0)).otherwise(tpr)
    curve = steps.groupBy("step").agg(F.avg(tpr).alias("mean_tpr"))
    end = df.sparkSession.range(1).select(F.lit(last).cast("long").alias("step"), F.lit(1.0).alias("mean_tpr"))
    return curve.unionByName(end).select("step", (F.col("step") / last).alias("fpr"), "mean_tpr")


def mean_roc_area(curve: DataFrame) -> DataFrame:
    """Trapezoid area under the table of :func:`mean_roc` (one row per grid point)."""
    order = Window.orderBy("step")
    width = F.col("fpr") - F.lag("fpr").over(order)
    height = (F.col("mean_tpr") + F.lag("mean_tpr").over(order)) / 2
    return curve.select((width * height).alias("a")).agg(F.sum("a").alias("mean_auc"))


def pr_curve(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall when everything at or above a score is called positive."""
    counts = score_counts(df, score, label, by)
    return counts.select(
        *by,
        "threshold",
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        F.try_divide(F.col("cum_pos"), F.col("all_pos")).alias("recall"),
    )


def max_f1(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Largest ``2PR / (P + R)`` over all thresholds."""
    curve = pr_curve(df, score, label, by)
    both = F.col("precision") + F.col("recall")
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), both)
    return curve.groupBy(*by).agg(F.max(f1).alias("max_f1"))


def brier(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of the probability, also with the reversed sign used for ranking."""
    error = F.avg(F.pow(F.col(score) - F.col(label), F.lit(2.0)))
    return df.groupBy(*by).agg(error.alias("brier"), (-error).alias("neg_brier"))


def accuracy(df: DataFrame, predicted: str, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose predicted class equals the label."""
    return df.groupBy(*by).agg(
        F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy")
    )
