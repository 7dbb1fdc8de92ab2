"""Models, selection, tuning and end-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, models, select, split, tune
from ..plans import jobs, recipe
from ..sources import tables
from .base import loan_pair, loans, query, rounded, table, with_pair

FEATURES = ["amount", "funds", "score"]


def numeric_pair(spark, sf):
    return tuple(d.select("id", "label", *FEATURES) for d in loan_pair(spark, sf))


def folded(spark, sf, folds: int = 5):
    df = loans(spark, sf).select("id", "label", *FEATURES)
    return split.stratified_fold(df, "id", "label", folds)


def learner(kind: str = "lightgbm", **params):
    params = params or {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.1}
    return models.ScoreClassifier(kind, FEATURES, "label", params)


def _scored(spark, sf, estimator):
    train, test = numeric_pair(spark, sf)
    return jobs.train_and_score(train, test, estimator)


@query("model_logreg")
def model_logreg(spark, sf):
    return _scored(spark, sf, models.registered("LogisticRegression", FEATURES, max_iter=100))


@query("model_rf")
def model_rf(spark, sf):
    return _scored(spark, sf, models.registered("RandomForest", FEATURES, n_estimators=5, max_depth=5))


@query("model_gbt")
def model_gbt(spark, sf):
    return _scored(spark, sf, models.registered("XGBoost", FEATURES, n_estimators=5, max_depth=4))


@query("model_gbt_lightgbm")
def model_gbt_lightgbm(spark, sf):
    return _scored(spark, sf, models.registered("LightGBM", FEATURES, n_estimators=5, max_depth=4))


@query("model_gbt_catboost")
def model_gbt_catboost(spark, sf):
    return _scored(spark, sf, models.registered("CatBoost", FEATURES, iterations=5, depth=4))


@query("model_gbt_ngboost")
def model_gbt_ngboost(spark, sf):
    return _scored(spark, sf, models.registered("NGBoost", FEATURES, n_estimators=5))


@query("model_gbt_gaps")
def model_gbt_gaps(spark, sf):
    """Boosted trees on columns with missing values, stopped early on the rows marked for it."""
    train, test = loan_pair(spark, sf)
    marked = split.hold_out(train, "id", 0.2, out="is_dev")
    estimator = models.registered("LightGBM", ["price", "balance", "nation"], validation="is_dev", n_estimators=60, learning_rate=0.2, max_depth=4)
    return jobs.train_and_score(marked, test, estimator)


STEPS = [("floor(price / 20000)", "tier"), ("floor(balance / 1000)", "step"), ("nation", "nation")]
_LONG = " UNION ALL ".join(f"SELECT label, {i} AS i, CAST({e} AS DOUBLE) AS v FROM train" for i, (e, _) in enumerate(STEPS))
_WORTH = "pow({g}, 2) / ({h} + 1)"


@query(
    "boosted_stump",
    with_pair(
        "SELECT id, round(1 / (1 + exp(-(ln(m / (1 - m)) + 0.3 * CASE WHEN (CASE i "
        + " ".join(f"WHEN {i} THEN coalesce({e} <= v, gap_left)" for i, (e, _) in enumerate(STEPS))
        + " END) THEN gl / (hl + 1) ELSE (g - gl) / (h - hl + 1) END))), 6) AS score FROM test, best",
        f"""long AS ({_LONG}), base AS (SELECT avg(label) AS m FROM train),
cells AS (SELECT i, v, sum(label - m) AS g, count(*) * any_value(m * (1 - m)) AS h, count(*) AS n FROM long, base GROUP BY i, v),
whole AS (SELECT i, sum(g) AS g, sum(h) AS h, sum(n) AS n, coalesce(sum(g) FILTER (v IS NULL), 0) AS gap_g, coalesce(sum(h) FILTER (v IS NULL), 0) AS gap_h,
    coalesce(sum(n) FILTER (v IS NULL), 0) AS gap_n FROM cells GROUP BY i),
cuts AS (SELECT i, v, sum(g) OVER w AS cg, sum(h) OVER w AS ch, sum(n) OVER w AS cn FROM cells WHERE v IS NOT NULL WINDOW w AS (PARTITION BY i ORDER BY v)),
sides AS (SELECT *, cg + CASE WHEN gap_left THEN gap_g ELSE 0 END AS gl, ch + CASE WHEN gap_left THEN gap_h ELSE 0 END AS hl,
    cn + CASE WHEN gap_left THEN gap_n ELSE 0 END AS nl FROM cuts JOIN whole USING (i), (VALUES (true), (false)) AS t(gap_left)),
best AS (SELECT sides.*, base.m FROM sides, base WHERE nl >= 1 AND n - nl >= 1
    ORDER BY {_WORTH.format(g="gl", h="hl")} + {_WORTH.format(g="(g - gl)", h="(h - hl)")} - {_WORTH.format(g="g", h="h")} DESC, i, v, gap_left DESC LIMIT 1)""",
    ),
)
def boosted_stump(spark, sf):
    """One cut over columns with gaps: every cut is tried, with the missing rows on either side."""
    train, test = (d.select("id", "label", *[F.expr(e).cast("double").alias(n) for e, n in STEPS]) for d in loan_pair(spark, sf))
    params = {"n_estimators": 1, "max_depth": 1, "learning_rate": 0.3, "reg_lambda": 1.0}
    model = models.ScoreClassifier("xgboost", [n for _, n in STEPS], "label", params).fit(train)
    return rounded(model.transform(test).select("id", "score"), "score")


@query("model_mlp")
def model_mlp(spark, sf):
    return _scored(spark, sf, models.registered("NeuralNetwork", FEATURES))


@query("scaled_fit_score")
def scaled_fit_score(spark, sf):
    train, test = numeric_pair(spark, sf)
    model = learner().fit(train)
    return rounded(metrics.auc_gini(model.transform(test)), "auc", "gini")


@query("batch_score")
def batch_score(spark, sf):
    train, test = numeric_pair(spark, sf)
    model = models.registered("LogisticRegression", FEATURES, max_iter=100).fit(train)
    return model.transform(test).select("id", "score", "predicted")


@query("model_stacking")
def model_stacking(spark, sf):
    base = [
        learner(n_estimators=2, max_depth=3),
        learner("catboost", iterations=2, depth=3),
        learner("xgboost", n_estimators=2, max_depth=3),
        learner("random_forest", n_estimators=3, max_depth=4, class_weight="balanced"),
    ]
    return _scored(spark, sf, models.Stacking(base, folds=5))


@query("model_blending")
def model_blending(spark, sf):
    sizes = {
        "LightGBM": {"n_estimators": 2}, "CatBoost": {"iterations": 2}, "XGBoost": {"n_estimators": 2},
        "RandomForest": {"n_estimators": 3}, "NGBoost": {"n_estimators": 2},
    }
    base = [models.registered(name, FEATURES, **size) for name, size in sizes.items()]
    return _scored(spark, sf, models.Blending(base, use_features=True))


@query("importance_rank")
def importance_rank(spark, sf):
    train, _ = numeric_pair(spark, sf)
    return models.importance_table(spark, FEATURES, learner().fit(train).importances())


@query("rfe_cv")
def rfe_cv(spark, sf):
    return select.rfe_cv(folded(spark, sf), learner())[1]


@query("covariate_shift")
def covariate_shift(spark, sf):
    train, test = numeric_pair(spark, sf)
    shift = select.CovariateShift(learner()).fit(train, test)
    rows = [(c, float(v), c in shift.selected) for c, v in zip(FEATURES, shift.importances)]
    return spark.createDataFrame(rows, "feature string, importance double, kept boolean")


@query("feature_select")
def feature_select(spark, sf):
    train, test = numeric_pair(spark, sf)
    return jobs.preprocess(train, test, learner(n_estimators=2, max_depth=3))[1]


@query("sfs_backward")
def sfs_backward(spark, sf):
    return select.sequential_backward(folded(spark, sf), learner("random_forest", n_estimators=3, max_depth=4), smallest=1)[1]


@query("grid_search")
def grid_search(spark, sf):
    grid = {"n_estimators": [2, 4], "max_depth": [2, 4]}
    return tune.grid_search(folded(spark, sf), "random_forest", FEATURES, grid)


@query("cv_auc")
def cv_auc(spark, sf):
    return tune.cross_validate(folded(spark, sf), learner())


@query("algos_compare")
def algos_compare(spark, sf):
    """All registered pipelines, each with its registered settings, compared on five folds."""
    names = [*models.REGISTRY, "Stacking", "Blending"]
    return tune.compare(folded(spark, sf), {name: models.registered(name, FEATURES) for name in names})


@query("learning_curve")
def learning_curve(spark, sf):
    train, test = numeric_pair(spark, sf)
    return tune.learning_curve(train, test, FEATURES, params={"learning_rate": 0.1})


# A raw application table in the competition's shape, derived row by row from the orders.
APPLICATION = [
    ("o_orderkey", "id"),
    ("CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END", "label"),
    ("CASE WHEN o_orderkey % 13 = 0 THEN 'None' ELSE 'T. ' || c_mktsegment END", "province"),
    ("CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'Quy-' || o_orderpriority END", "district"),
    ("'[''' || c_mktsegment || ''', ''' || o_orderpriority || ''']'", "FIELD_1"),
    ("CASE WHEN o_orderkey % 11 = 0 THEN 'na' ELSE o_orderpriority END", "FIELD_2"),
    ("CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE c_acctbal END", "FIELD_3"),
    ("CASE WHEN o_orderkey % 10 < 9 THEN NULL ELSE c_acctbal END", "FIELD_4"),
    ("CASE WHEN o_orderkey % 19 = 0 THEN 'None' ELSE CAST(c_nationkey AS STRING) END", "FIELD_5"),
    ("c_nationkey", "FIELD_6"),
    ("CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE CAST(o_custkey AS INTEGER) END", "FIELD_7"),
    ("CASE o_orderpriority WHEN '1-URGENT' THEN 'One' WHEN '2-HIGH' THEN 'Two' WHEN '5-LOW' THEN 'Zero' ELSE NULL END", "FIELD_8"),
]


def applications(spark, sf):
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.selectExpr(*[f"{e} AS {n}" for e, n in APPLICATION])


def application_spec() -> recipe.CleaningSpec:
    return recipe.CleaningSpec(
        rename_prefix="FIELD_",
        rename_count=8,
        names=["province", "district"],
        unknown=["2", "8"],
        lower=["2"],
        lists=["1"],
        composites={"district": ["province", "district"]},
        ordinals={"8": {"Zero": 0, "One": 1, "Two": 2, "Three": 3, "Four": 4}},
        mean_encoded=["province", "2"],
        whitelists={"6": [1, 2, 3, 4, 6]},
        numbers=["5"],
        coalesced={"age": ["3", "7"]},
    )


_TAGS = [
    "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW",
    "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY",
]
_RAW = "SELECT " + ", ".join(
    f'{e.replace("AS STRING", "AS VARCHAR")} AS "{n}"' for e, n in APPLICATION
) + " FROM orders JOIN customer ON o_custkey = c_custkey"
_PLAIN = "replace(replace(replace(replace(lower({}), ' ', ''), 'y', 'i'), '.', ''), '-', '')"
_PROVINCE = _PLAIN.format("coalesce(nullif(province, 'None'), 'unk_province')")
_DISTRICT = _PLAIN.format("coalesce(district, 'unk_district')")
_SECOND = "lower(coalesce(nullif(\"FIELD_2\", 'na'), 'unk_2'))"
_GAPS = (
    "(province = 'None')::INTEGER + (district IS NULL)::INTEGER + (\"FIELD_2\" = 'na')::INTEGER + (\"FIELD_3\" IS NULL)::INTEGER "
    "+ (\"FIELD_5\" = 'None')::INTEGER + (\"FIELD_7\" = -1)::INTEGER + (\"FIELD_8\" IS NULL)::INTEGER"
)


@query(
    "clean_recipe",
    f"WITH raw AS ({_RAW}), p AS (SELECT {_PROVINCE} AS v, avg(label) AS m FROM raw GROUP BY 1), "
    f"s AS (SELECT {_SECOND} AS v, avg(label) AS m FROM raw GROUP BY 1) "
    f"SELECT id, label, {_PROVINCE} AS province, {_PROVINCE} || ' - ' || {_DISTRICT} AS district, "
    f"{_SECOND} AS \"2\", \"FIELD_3\" AS \"3\", try_cast(nullif(\"FIELD_5\", 'None') AS DOUBLE) AS \"5\", "
    "CASE WHEN \"FIELD_6\" IN (1, 2, 3, 4, 6) THEN \"FIELD_6\"::DOUBLE END AS \"6\", "
    "nullif(\"FIELD_7\", -1)::DOUBLE AS \"7\", "
    "CASE \"FIELD_8\" WHEN 'Zero' THEN 0.0 WHEN 'One' THEN 1.0 WHEN 'Two' THEN 2.0 ELSE -1.0 END::DOUBLE AS \"8\", "
    "(province = 'None')::INTEGER::DOUBLE AS province_ismiss, (district IS NULL)::INTEGER::DOUBLE AS district_ismiss, "
    "(\"FIELD_2\" = 'na')::INTEGER::DOUBLE AS \"2_ismiss\", (\"FIELD_3\" IS NULL)::INTEGER::DOUBLE AS \"3_ismiss\", "
    "(\"FIELD_5\" = 'None')::INTEGER::DOUBLE AS \"5_ismiss\", (\"FIELD_7\" = -1)::INTEGER::DOUBLE AS \"7_ismiss\", "
    "(\"FIELD_8\" IS NULL)::INTEGER::DOUBLE AS \"8_ismiss\", "
    f"({_GAPS})::DOUBLE AS incomplete, 2.0::DOUBLE AS \"1_count\", "
    + ", ".join(f"(contains(\"FIELD_1\", '{t}'))::INTEGER::DOUBLE AS \"1_count_{t}\"" for t in _TAGS)
    + f", round((SELECT m FROM p WHERE v = {_PROVINCE}), 6) AS province_te, round((SELECT m FROM s WHERE v = {_SECOND}), 6) AS \"2_te\", "
    "coalesce(\"FIELD_3\", nullif(\"FIELD_7\", -1)) AS age FROM raw",
)
def clean_recipe(spark, sf):
    df = applications(spark, sf)
    cleaned = recipe.CleaningRecipe(application_spec()).fit(df).transform(df)
    return rounded(cleaned.drop("1"), "province_te", "2_te")


@query("woe_recipe")
def woe_recipe(spark, sf):
    train, test = loan_pair(spark, sf)
    columns = ["price", "balance", "nation", "priority", "segment"]
    extraction = recipe.ExtractionRecipe(columns, iv_limit=0.0001, min_gain=0.02).fit(train)
    out = extraction.transform(test)
    return out.select("id", *[c for c in out.columns if c.endswith("_woe")])


@query("clean_and_extract")
def clean_and_extract(spark, sf):
    df = applications(spark, sf)
    parts = split.hash_fold(df, "id", 5)
    train, dev = (tables.fold_part(parts, 0, dev).drop("fold") for dev in (False, True))
    columns = ["3", "5", "7", "8", "province", "2"]
    return jobs.clean_and_extract(train, dev, application_spec(), columns, iv_limit=0.0001)[1].drop("1")
