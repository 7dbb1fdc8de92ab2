"""Ranking and probability metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, split
from ..operators.lookup import attach
from ..session import shared_path, store
from ..sources import sinks
from .base import loans, query, rounded, sql_fold, with_loans


def folded(spark, sf):
    df = loans(spark, sf).select("id", "label", "score")
    return split.hash_fold(df, "id", 5, 10000)


# One row per (fold, score) with running counts from the highest score.
_COUNTS = (
    f"c AS (SELECT {sql_fold(10000, 5)} AS fold, score AS threshold, sum(label) AS pos, count(*) - sum(label) AS neg "
    "FROM loans GROUP BY 1, 2), "
    "r AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER g AS p, sum(neg) OVER g AS n FROM c "
    "WINDOW w AS (PARTITION BY fold ORDER BY threshold DESC), g AS (PARTITION BY fold))"
)
_WHOLE = (
    "c AS (SELECT score AS threshold, sum(label) AS pos, count(*) - sum(label) AS neg FROM loans GROUP BY 1), "
    "r AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c "
    "WINDOW w AS (ORDER BY threshold DESC))"
)
_AUC = "sum(neg * (cp - pos / 2)) / (any_value(p) * any_value(n))"


@query(
    "auc_gini",
    with_loans(
        f"SELECT CAST(any_value(p) AS BIGINT) AS n_pos, CAST(any_value(n) AS BIGINT) AS n_neg, round({_AUC}, 6) AS auc, "
        f"round(2 * {_AUC} - 1, 6) AS gini FROM r",
        _WHOLE,
    ),
)
def auc_gini(spark, sf):
    return rounded(metrics.auc_gini(loans(spark, sf)), "auc", "gini")


@query(
    "auc_by_fold",
    with_loans(
        f"SELECT CAST(fold AS INTEGER) AS fold, CAST(any_value(p) AS BIGINT) AS n_pos, CAST(any_value(n) AS BIGINT) AS n_neg, "
        f"round({_AUC}, 6) AS auc, round(2 * {_AUC} - 1, 6) AS gini FROM r GROUP BY fold",
        _COUNTS,
    ),
)
def auc_by_fold(spark, sf):
    return rounded(metrics.auc_gini(folded(spark, sf), by=["fold"]), "auc", "gini")


_TRAIN_DEV = (
    f"f AS (SELECT label, nation, {sql_fold(10000, 5)} AS held FROM loans), "
    "t AS (SELECT nation, held, count(*) AS n, sum(label) AS e FROM f GROUP BY 1, 2), "
    "m AS (SELECT nation, k, sum(e) / sum(n) AS score FROM t, range(5) ks(k) WHERE held <> k GROUP BY 1, 2), "
    "c AS (SELECT k AS fold, CASE WHEN held = k THEN 'dev' ELSE 'train' END AS part, score AS threshold, sum(label) AS pos, "
    "count(*) - sum(label) AS neg FROM f JOIN m ON f.nation IS NOT DISTINCT FROM m.nation GROUP BY 1, 2, 3), "
    "r AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER g AS p, sum(neg) OVER g AS n FROM c "
    "WINDOW w AS (PARTITION BY fold, part ORDER BY threshold DESC), g AS (PARTITION BY fold, part))"
)


@query(
    "auc_train_dev",
    with_loans(
        f"SELECT CAST(fold AS INTEGER) AS fold, part, CAST(any_value(p) AS BIGINT) AS n_pos, CAST(any_value(n) AS BIGINT) AS n_neg, "
        f"round({_AUC}, 6) AS auc, round(2 * {_AUC} - 1, 6) AS gini FROM r GROUP BY fold, part",
        _TRAIN_DEV,
    ),
)
def auc_train_dev(spark, sf):
    """A model per fold: the mean label of the row's nation over the rows outside the fold."""
    df = split.hash_fold(loans(spark, sf).select("id", "label", "nation"), "id", 5, 10000)

    def outside(k, value):
        return F.sum(F.when(F.col("fold") != k, value))

    models = df.groupBy("nation").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.try_divide(outside(k, F.col("label")), outside(k, F.lit(1))).alias(f"score_{k}") for k in range(5)],
    )
    scored = attach(df, store(models), ["nation"], "n")
    return rounded(metrics.auc_train_dev(scored, [f"score_{k}" for k in range(5)]), "auc", "gini")


@query(
    "params_log",
    with_loans(
        f"SELECT run, param, value, round({_AUC}, 6) AS metric FROM r, (VALUES ('first', 'fold', '5'), "
        "('first', 'score', '\"score\"'), ('second', 'fold', '4')) v(run, param, value) GROUP BY 1, 2, 3",
        _WHOLE,
    ),
)
def params_log(spark, sf):
    """A table of tuning results whose first run is written twice."""
    auc = metrics.auc_gini(loans(spark, sf)).first()["auc"]
    path = shared_path(spark, "params")
    for run, params in (("first", {"fold": 5, "score": "score"}), ("second", {"fold": 4}), ("first", {"fold": 9})):
        sinks.append_params(spark, path, run, params, auc)
    return rounded(spark.read.parquet(path), "metric")


@query(
    "auc_mean",
    with_loans(
        "SELECT round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc, round(avg(2 * auc - 1), 6) AS mean_gini, "
        f"count(*) AS folds FROM (SELECT fold, {_AUC} AS auc FROM r GROUP BY fold)",
        _COUNTS,
    ),
)
def auc_mean(spark, sf):
    return rounded(metrics.cross_validated_auc(folded(spark, sf)), "mean_auc", "std_auc", "mean_gini")


@query(
    "max_f1",
    with_loans("SELECT round(max(2 * cp / (cp + cn + p)), 6) AS max_f1 FROM r", _WHOLE),
)
def max_f1(spark, sf):
    return rounded(metrics.max_f1(loans(spark, sf)), "max_f1")


@query(
    "brier",
    with_loans(
        f"SELECT CAST({sql_fold(10000, 5)} AS INTEGER) AS fold, round(avg(pow(score - label, 2)), 6) AS brier, "
        "round(-avg(pow(score - label, 2)), 6) AS neg_brier FROM loans GROUP BY 1"
    ),
)
def brier(spark, sf):
    return rounded(metrics.brier(folded(spark, sf), by=["fold"]), "brier", "neg_brier")


@query(
    "roc_points",
    with_loans(
        "SELECT threshold, round(cn / n, 6) AS fpr, round(cp / p, 6) AS tpr FROM r UNION ALL SELECT NULL, 0.0, 0.0",
        _WHOLE,
    ),
)
def roc_points(spark, sf):
    return rounded(metrics.roc_points(loans(spark, sf)), "fpr", "tpr")


_GRID = (
    _COUNTS
    + ", s AS (SELECT fold, (cn - neg) / n AS f0, cn / n AS f1, (cp - pos) / p AS t0, cp / p AS t1, cn - neg AS k0, cn AS k1, n "
    "FROM r WHERE neg > 0), "
    "curve AS (SELECT step, avg(CASE WHEN step = 0 THEN 0.0 ELSE t0 + (step / 99.0 - f0) / (f1 - f0) * (t1 - t0) END) AS m "
    "FROM s JOIN range(0, 99) t(step) ON step * n >= k0 * 99 AND step * n < k1 * 99 GROUP BY step "
    "UNION ALL SELECT 99, 1.0)"
)


@query(
    "roc_mean_curve",
    with_loans("SELECT step, round(step / 99.0, 6) AS fpr, round(m, 6) AS mean_tpr FROM curve", _GRID),
)
def roc_mean_curve(spark, sf):
    return rounded(metrics.mean_roc(folded(spark, sf)), "fpr", "mean_tpr")


@query(
    "roc_mean_area",
    with_loans(
        "SELECT round(sum((a + b) / 2 / 99.0), 6) AS mean_auc FROM (SELECT m AS a, lead(m) OVER (ORDER BY step) AS b FROM curve) "
        "WHERE b IS NOT NULL",
        _GRID,
    ),
)
def roc_mean_area(spark, sf):
    return rounded(metrics.mean_roc_area(metrics.mean_roc(folded(spark, sf))), "mean_auc")


@query(
    "pr_curve",
    with_loans('SELECT threshold, round(cp / (cp + cn), 6) AS "precision", round(cp / p, 6) AS recall FROM r', _WHOLE),
)
def pr_curve(spark, sf):
    return rounded(metrics.pr_curve(loans(spark, sf)), "precision", "recall")


@query(
    "accuracy",
    with_loans("SELECT round(avg(CAST((score > 0.5) = (label = 1) AS INTEGER)), 6) AS accuracy FROM loans"),
)
def accuracy(spark, sf):
    df = loans(spark, sf).withColumn("predicted", (F.col("score") > 0.5).cast("int"))
    return rounded(metrics.accuracy(df, "predicted"), "accuracy")
