"""Lookups and categorical encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode, tune
from ..operators.lookup import attach
from ..session import materialize
from .base import as_long, loan_pair, query, r6, rounded, sql_even_fold, sql_fold, table, with_pair

CATEGORIES = ["priority", "segment"]


def _value(c: str) -> str:
    return f"coalesce({c}, 'none')"


@query(
    "lookup_encode",
    "SELECT c_custkey, coalesce(code, -1) AS code FROM customer LEFT JOIN "
    "(SELECT n_nationkey AS k, n_regionkey AS code FROM nation WHERE n_regionkey <> 2) ON c_nationkey = k",
)
def lookup_encode(spark, sf):
    codes = materialize(
        table(spark, sf, "nation").filter("n_regionkey <> 2").selectExpr("n_nationkey AS c_nationkey", "n_regionkey AS code")
    )
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return attach(customers, codes, ["c_nationkey"]).select(
        "c_custkey", F.coalesce("code", F.lit(-1)).alias("code")
    )


def _kfold_ctes() -> str:
    parts = []
    for c in ("segment", "nation"):
        parts.append(
            f"{c}_f AS (SELECT CAST({c} AS VARCHAR) AS v, {sql_fold(10000, 5)} AS f, count(*) AS n, sum(label) AS s "
            f"FROM train WHERE {c} IS NOT NULL GROUP BY 1, 2), "
            f"{c}_e AS (SELECT v, f, n, CASE WHEN sum(n) OVER w > n THEN (sum(s) OVER w - s) / (sum(n) OVER w - n) "
            f"ELSE sum(s) OVER w / sum(n) OVER w END AS e FROM {c}_f WINDOW w AS (PARTITION BY v)), "
            f"{c}_t AS (SELECT v, sum(n * e) / sum(n) AS e FROM {c}_e GROUP BY v)"
        )
    return ", ".join(parts)


@query(
    "kfold_target_encode",
    with_pair(
        "SELECT id, "
        + ", ".join(
            f"(SELECT round(e, 6) FROM {c}_e WHERE v = CAST({c} AS VARCHAR) AND f = {sql_fold(10000, 5)}) AS {c}"
            for c in ("segment", "nation")
        )
        + " FROM train",
        _kfold_ctes(),
    ),
)
def kfold_target_encode(spark, sf):
    train, _ = loan_pair(spark, sf)
    train = train.select("id", "label", "segment", "nation")
    model = encode.KFoldTargetEncoder(["segment", "nation"], "label", "id").fit(train)
    return rounded(model.transform_train(train).drop("label"), "segment", "nation")


def _priority_ctes() -> str:
    return (
        f"f AS (SELECT priority AS v, {sql_fold(10000, 5)} AS f, count(*) AS n, sum(label) AS s FROM train GROUP BY 1, 2), "
        "e AS (SELECT v, f, n, CASE WHEN sum(n) OVER w > n THEN (sum(s) OVER w - s) / (sum(n) OVER w - n) "
        "ELSE sum(s) OVER w / sum(n) OVER w END AS e FROM f WINDOW w AS (PARTITION BY v)), "
        "t AS (SELECT v, sum(n * e) / sum(n) AS e FROM e GROUP BY v), g AS (SELECT sum(n * e) / sum(n) AS g FROM e)"
    )


@query(
    "kfold_target_encode_test",
    with_pair(
        "SELECT id, round(coalesce((SELECT t.e FROM t WHERE v = priority), (SELECT g FROM g)), 6) AS priority FROM test",
        _priority_ctes(),
    ),
)
def kfold_target_encode_test(spark, sf):
    train, test = (d.select("id", "label", "priority") for d in loan_pair(spark, sf))
    model = encode.KFoldTargetEncoder(["priority"], "label", "id").fit(train)
    return rounded(model.transform(test).select("id", "priority"), "priority")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "none"]
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "None"]


@query(
    "one_hot",
    with_pair(
        "SELECT id, "
        + ", ".join(
            f"CAST({_value(c)} = '{v}' AS DOUBLE) AS \"{c}_ohe_{v}\""
            for c, vs in (("priority", _PRIORITIES), ("segment", _SEGMENTS))
            for v in vs
        )
        + " FROM test"
    ),
)
def one_hot(spark, sf):
    train, test = loan_pair(spark, sf)
    model = encode.OneHotEncoder(CATEGORIES, "id").fit(train)
    return model.transform(test.select("id", *CATEGORIES)).drop(*CATEGORIES)


@query(
    "label_encode",
    with_pair(
        "SELECT id, " + ", ".join(f"coalesce((SELECT code FROM {c}_l WHERE v = {_value(c)}), -1) AS {c}_labeled" for c in CATEGORIES)
        + " FROM test",
        ", ".join(
            f"{c}_l AS (SELECT v, row_number() OVER (ORDER BY first) - 1 AS code FROM "
            f"(SELECT {_value(c)} AS v, min(id) AS first FROM train GROUP BY 1))"
            for c in CATEGORIES
        ),
    ),
)
def label_encode(spark, sf):
    train, test = loan_pair(spark, sf)
    model = encode.LabelEncoder(CATEGORIES, "id").fit(train)
    return as_long(
        model.transform(test.select("id", *CATEGORIES)).drop(*CATEGORIES), *[f"{c}_labeled" for c in CATEGORIES]
    )


@query(
    "freq_encode",
    with_pair(
        "SELECT id, "
        + ", ".join(
            f"round(coalesce((SELECT n / (SELECT count(*) FROM train) FROM {c}_n WHERE v = {_value(c)}), 0), 6) AS {c}_freq"
            for c in CATEGORIES
        )
        + " FROM test",
        ", ".join(f"{c}_n AS (SELECT {_value(c)} AS v, count(*) AS n FROM train GROUP BY 1)" for c in CATEGORIES),
    ),
)
def freq_encode(spark, sf):
    train, test = loan_pair(spark, sf)
    model = encode.FrequencyEncoder(CATEGORIES).fit(train)
    out = model.transform(test.select("id", *CATEGORIES)).drop(*CATEGORIES)
    return rounded(out, *[f"{c}_freq" for c in CATEGORIES])


_GLOBAL = "(SELECT avg(label) FROM train)"


@query(
    "mean_encode_smooth",
    with_pair(
        "SELECT id, "
        + ", ".join(
            f"round(coalesce((SELECT (s + 5 * {_GLOBAL}) / (n + 5) FROM {c}_m WHERE v = {_value(c)}), {_GLOBAL}), 6) AS {c}_mean"
            for c in CATEGORIES
        )
        + " FROM test",
        ", ".join(
            f"{c}_m AS (SELECT {_value(c)} AS v, count(*) AS n, sum(label) AS s FROM train GROUP BY 1)" for c in CATEGORIES
        ),
    ),
)
def mean_encode_smooth(spark, sf):
    train, test = loan_pair(spark, sf)
    model = encode.MeanEncoder(CATEGORIES, "label", alpha=5).fit(train)
    out = model.transform(test.select("id", *CATEGORIES)).drop(*CATEGORIES)
    return rounded(out, *[f"{c}_mean" for c in CATEGORIES])


@query(
    "mean_encode_oof",
    with_pair(
        "SELECT id, "
        + ", ".join(
            f"(SELECT round(coalesce((sum(s) + 5 * {_GLOBAL}) / (sum(n) + 5), {_GLOBAL}), 6) "
            f"FROM {c}_m m WHERE m.v = {_value('folded.' + c)} AND m.fold <> folded.fold) AS {c}_mean"
            for c in CATEGORIES
        )
        + " FROM folded",
        f"folded AS (SELECT *, {sql_even_fold(913100, 5, 'label')} AS fold FROM train), "
        + ", ".join(
            f"{c}_m AS (SELECT {_value(c)} AS v, fold, count(*) AS n, sum(label) AS s FROM folded GROUP BY 1, 2)"
            for c in CATEGORIES
        ),
    ),
)
def mean_encode_oof(spark, sf):
    train, _ = loan_pair(spark, sf)
    train = train.select("id", "label", *CATEGORIES)
    model = encode.MeanEncoder(CATEGORIES, "label", alpha=5, folds=5, id_col="id").fit(train)
    out = model.transform_train(train).drop("label", *CATEGORIES)
    return rounded(out, *[f"{c}_mean" for c in CATEGORIES])


_MULTI = ["priority", "segment", "nation", "constant"]


@query(
    "mean_encode_multi",
    with_pair(
        "SELECT id, "
        + ", ".join(
            f"round(coalesce((SELECT m FROM {c}_m WHERE v = coalesce(CAST({c} AS VARCHAR), 'none')), -1), 6) AS {c}_te"
            for c in _MULTI
        )
        + " FROM test",
        ", ".join(
            f"{c}_m AS (SELECT coalesce(CAST({c} AS VARCHAR), 'none') AS v, avg(label) AS m FROM train GROUP BY 1)" for c in _MULTI
        ),
    ),
)
def mean_encode_multi(spark, sf):
    train, test = loan_pair(spark, sf)
    model = encode.MeanEncoder(_MULTI, "label", default=-1.0, suffix="_te").fit(train)
    out = model.transform(test.select("id", *_MULTI)).drop(*_MULTI)
    return out.select("id", *[r6(f"{c}_te").alias(f"{c}_te") for c in _MULTI])


@query("encoder_comparison")
def encoder_comparison(spark, sf):
    train, test = loan_pair(spark, sf)
    return tune.encoder_comparison(train, test, CATEGORIES, "label", "id", params={"learning_rate": 0.1})
