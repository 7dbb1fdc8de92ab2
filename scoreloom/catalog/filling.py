"""Imputation, scaling, components, clusters and oversampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bpca, closest, features, impute, kmeans, resample
from .base import loan_pair, loans, query, rounded, table, with_loans, with_pair


@query(
    "mean_impute",
    with_loans(
        "SELECT id, round(coalesce(price, (SELECT avg(price) FROM loans)), 4) AS price, "
        "round(coalesce(balance, (SELECT avg(balance) FROM loans)), 4) AS balance FROM loans"
    ),
)
def mean_impute(spark, sf):
    df = loans(spark, sf).select("id", "price", "balance")
    filled = impute.MeanImputer(["price", "balance"]).fit(df).transform(df)
    return filled.withColumns({c: F.round(c, 4) for c in ("price", "balance")})


@query(
    "hot_deck_fill",
    with_pair(
        "SELECT t.id, coalesce(t.price, d.price) AS price, coalesce(t.segment, d.segment) AS segment "
        "FROM (SELECT *, row_number() OVER (ORDER BY md5('11|' || id), id) AS rn FROM test) t "
        "JOIN (SELECT *, row_number() OVER (ORDER BY md5('11|' || id), id) AS rn FROM train) d "
        "ON d.rn = (t.rn - 1) % (SELECT count(*) FROM train) + 1"
    ),
)
def hot_deck_fill(spark, sf):
    train, test = (d.select("id", "price", "segment") for d in loan_pair(spark, sf))
    return impute.hot_deck_fill(train, test, ["price", "segment"], "id", 11)


CLOSE_COLUMNS = [
    ("CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE c_nationkey END", "nation"),
    ("CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END", "priority"),
    ("CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE c_mktsegment END", "segment"),
    ("CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE CAST(floor(o_totalprice / 10000) AS INTEGER) END", "band"),
]
_CLOSE = ", ".join(f"{e} AS {n}" for e, n in CLOSE_COLUMNS)
_NAMES = [n for _, n in CLOSE_COLUMNS]


@query(
    "closest_fit",
    f"WITH b AS (SELECT o_orderkey AS id, {_CLOSE} FROM orders JOIN customer ON o_custkey = c_custkey), "
    "best AS (SELECT r.id, arg_min(d.id, ("
    + " + ".join(f"(r.{c} IS NULL OR d.{c} IS NULL)::BIGINT" for c in _NAMES)
    + ") * 1000000000 + d.id) AS closest_id FROM b r JOIN b d ON r.id <> d.id AND "
    + " AND ".join(f"(r.{c} IS NULL OR d.{c} IS NULL OR r.{c} = d.{c})" for c in _NAMES)
    + " WHERE "
    + " OR ".join(f"r.{c} IS NULL" for c in _NAMES)
    + " GROUP BY r.id) SELECT b.id, "
    + ", ".join(f"coalesce(b.{c}, d.{c}) AS {c}" for c in _NAMES)
    + ", closest_id FROM b LEFT JOIN best USING (id) LEFT JOIN b d ON d.id = closest_id",
)
def closest_fit(spark, sf):
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    df = joined.selectExpr("o_orderkey AS id", *[f"{e} AS {n}" for e, n in CLOSE_COLUMNS])
    return closest.closest_fit(df, _NAMES, "id")


def vectors(spark, sf, size: int = 64):
    df = table(spark, sf, "embeddings")
    return df.select(
        F.col("vec_id").alias("id"),
        (F.col("label") < 1).cast("int").alias("label"),
        *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(size)],
    )


VECTOR_NAMES = [f"x{i}" for i in range(64)]


def holey(spark, sf):
    """Correlated order amounts with derived gaps."""
    return table(spark, sf, "lineitem").selectExpr(
        "CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity / 50 END AS quantity",
        "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice / 100000 END AS gross",
        "CASE WHEN l_linenumber = 4 THEN NULL ELSE l_extendedprice * (1 - l_discount) / 100000 END AS net",
        "CASE WHEN l_linenumber = 5 THEN NULL ELSE l_extendedprice * (1 + l_tax) / 100000 END AS charged",
        "l_discount AS discount",
    )


HOLEY_NAMES = ["quantity", "gross", "net", "charged", "discount"]


@query("bpca_fit")
def bpca_fit(spark, sf):
    model = bpca.BayesianPCA(VECTOR_NAMES, updates=30).fit(vectors(spark, sf))
    rows = [(i, float(a), i in model.info["captured"]) for i, a in enumerate(model.info["alpha"])]
    return spark.createDataFrame(rows, "dimension int, alpha double, captured boolean")


@query("bpca_reconstruct")
def bpca_reconstruct(spark, sf):
    df = vectors(spark, sf)
    model = bpca.BayesianPCA(VECTOR_NAMES, updates=30).fit(df)
    return model.reconstruct(model.transform(df)).drop(*VECTOR_NAMES)


@query("bpca_impute")
def bpca_impute(spark, sf):
    df = holey(spark, sf)
    return bpca.BPCAImputer(HOLEY_NAMES, epochs=10).fit(df).transform(df)


@query("pca_variance")
def pca_variance(spark, sf):
    df = vectors(spark, sf)
    return features.PCAFeatures(VECTOR_NAMES, 0.97).fit(df).transform(df).drop(*VECTOR_NAMES)


_PLANE = "SELECT id, amount / 100000.0 AS x, (funds + amount / 20.0) / 10000.0 AS y FROM loans"


@query(
    "pca_block",
    with_loans(
        "SELECT id, round(p * (x - mx) + q * (y - my), 6) AS pca_0, "
        "round(CASE WHEN a >= c THEN p * (y - my) - q * (x - mx) ELSE q * (x - mx) - p * (y - my) END, 6) AS pca_1 FROM d, u",
        f"d AS ({_PLANE}), "
        "s AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM d), "
        "l AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS top FROM s), "
        "v AS (SELECT *, CASE WHEN a >= c THEN top - c ELSE b END AS vx, CASE WHEN a >= c THEN b ELSE top - a END AS vy FROM l), "
        "u AS (SELECT mx, my, a, c, vx / sqrt(vx * vx + vy * vy) AS p, vy / sqrt(vx * vx + vy * vy) AS q FROM v)",
    ),
)
def pca_block(spark, sf):
    """All principal components of two columns; the twin solves the 2 x 2 problem in closed form."""
    df = loans(spark, sf).selectExpr("id", "amount / 100000.0 AS x", "(funds + amount / 20.0) / 10000.0 AS y")
    return rounded(features.pca_block(["x", "y"]).fit(df).transform(df).drop("x", "y"), "pca_0", "pca_1")


@query("kmeans_features")
def kmeans_features(spark, sf):
    df = vectors(spark, sf)
    model = features.KMeansFeaturizer(VECTOR_NAMES, k=100, target="label", seeds=20, max_iter=20).fit(df)
    return model.transform(df).select("id", "cluster_distance")


@query(
    "two_means",
    with_loans(
        "SELECT round(s / n, 4) AS lower, round((ts - s) / (tn - n), 4) AS upper, n AS n_lower, tn - n AS n_upper FROM c WHERE tn > n "
        "ORDER BY s * s / n + (ts - s) * (ts - s) / (tn - n) DESC LIMIT 1",
        "v AS (SELECT amount / 1000.0 AS x, count(*) AS m FROM loans GROUP BY 1), "
        "c AS (SELECT sum(m) OVER (ORDER BY x) AS n, sum(m * x) OVER (ORDER BY x) AS s, sum(m) OVER () AS tn, sum(m * x) OVER () AS ts FROM v)",
    ),
)
def two_means(spark, sf):
    """The best two clusters of one column; the twin tries every cut."""
    x = F.expr("amount / 1000.0").cast("double")
    df = loans(spark, sf).select(x.alias("x"))
    found, _ = kmeans.ManyStarts(2, starts=20, max_iter=100, tol=1e-7).fit(df.select(F.array("x").alias("x")))
    lower, upper = sorted(float(c) for c in found[:, 0])
    side = F.abs(F.col("x") - F.lit(lower)) <= F.abs(F.col("x") - F.lit(upper))
    return df.agg(
        F.round(F.lit(lower), 4).alias("lower"),
        F.round(F.lit(upper), 4).alias("upper"),
        F.count(F.when(side, 1)).alias("n_lower"),
        F.count(F.when(~side, 1)).alias("n_upper"),
    )


_CENTERS = [[0.0] * 64, [0.1] * 64, [(-1) ** i * 0.2 for i in range(64)]]


@query(
    "centroid_distance",
    "SELECT id, "
    + ", ".join(
        "round(sqrt(" + " + ".join(f"pow(x{i} - ({c[i]!r}), 2)" for i in range(64)) + f"), 6) AS d{k}"
        for k, c in enumerate(_CENTERS)
    )
    + " FROM (SELECT vec_id AS id, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(64))
    + " FROM embeddings)",
)
def centroid_distance(spark, sf):
    model = features.KMeansModel({"columns": VECTOR_NAMES, "centers": _CENTERS, "out": "d"})
    out = model.transform(vectors(spark, sf))
    return rounded(
        out.select("id", *[F.col("d")[k].alias(f"d{k}") for k in range(len(_CENTERS))]), "d0", "d1", "d2"
    )


@query("smote")
def smote(spark, sf):
    df = loans(spark, sf).select("id", F.expr("CASE WHEN priority = '5-LOW' AND label = 1 THEN 1 ELSE 0 END").alias("label"), "amount", "funds")
    return resample.smote(df, ["amount", "funds"], "label", "id", 0.25, 5)


@query(
    "smote_counts",
    with_loans(
        "SELECT label, CASE WHEN label = 1 THEN greatest(count(*), CAST(floor(0.25 * (SELECT count(*) FROM m WHERE label = 0)) AS BIGINT)) "
        "ELSE count(*) END AS rows FROM m GROUP BY label",
        "m AS (SELECT CASE WHEN priority = '5-LOW' AND label = 1 THEN 1 ELSE 0 END AS label FROM loans)",
    ),
)
def smote_counts(spark, sf):
    return resample.class_counts(smote(spark, sf), "label")


@query(
    "minmax_scale",
    with_loans(
        "SELECT id, "
        + ", ".join(
            f"round(({c} - (SELECT min({c}) FROM loans)) / (SELECT max({c}) - min({c}) FROM loans), 6) AS {c}"
            for c in ("price", "balance")
        )
        + ", 0.0::DOUBLE AS constant FROM loans"
    ),
)
def minmax_scale(spark, sf):
    df = loans(spark, sf).select("id", "price", "balance", "constant")
    return rounded(features.MinMaxScaler(["price", "balance", "constant"]).fit(df).transform(df), "price", "balance")
