"""WOE, information value, profiles and correlation filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile, woe
from .base import as_long, loans, query, r6, rounded, table, with_loans

NUMERIC, CATEGORICAL = ["price", "balance"], ["priority", "segment"]
MEASURES = [
    "DEFAULT_RATE", "NONDEFAULT_RATE", "DIST_DEFAULT", "NONDIST_DEFAULT", "WOE", "IV",
]


def sql_edges(column: str, bins: int) -> str:
    """One row: the sorted distinct interior quantiles of a column."""
    fractions = ", ".join(repr(i / bins) for i in range(1, bins))
    return (
        f"SELECT '{column}' AS v, list_sort(list_distinct(list_filter(quantile_cont({column}, [{fractions}]), "
        f"lambda e: e > lo AND e < hi))) AS edges "
        f"FROM loans, (SELECT min({column}) AS lo, max({column}) AS hi FROM loans) GROUP BY lo, hi"
    )


def sql_numeric_bins(columns, bins: int) -> str:
    """CTEs ``cells`` (row level) and ``nbins`` (bin counts) for numeric columns."""
    edges = " UNION ALL ".join(f"({sql_edges(c, bins)})" for c in columns)
    long = " UNION ALL ".join(f"SELECT '{c}' AS v, {c} AS x, label AS y FROM loans" for c in columns)
    return (
        f"edges AS ({edges}), "
        f"cells AS (SELECT l.v, x, y, CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(edges, lambda e: e < x)) END AS bin "
        f"FROM ({long}) l JOIN edges USING (v)), "
        "nbins AS (SELECT v AS \"VARNAME\", CAST(bin AS INTEGER) AS \"BIN\", min(x) AS \"MIN_VALUE\", max(x) AS \"MAX_VALUE\", "
        "count(*) AS \"COUNT\", CAST(sum(y) AS BIGINT) AS \"DEFAULT\", CAST(count(*) - sum(y) AS BIGINT) AS \"NONDEFAULT\" "
        "FROM cells GROUP BY v, bin)"
    )


def sql_category_bins(columns) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS v, CAST({c} AS VARCHAR) AS x, label AS y FROM loans" for c in columns)
    return (
        'cbins AS (SELECT v AS "VARNAME", x AS "MIN_VALUE", x AS "MAX_VALUE", count(*) AS "COUNT", '
        'CAST(sum(y) AS BIGINT) AS "DEFAULT", CAST(count(*) - sum(y) AS BIGINT) AS "NONDEFAULT" '
        f"FROM ({long}) GROUP BY v, x)"
    )


def sql_measures(source: str, name: str) -> str:
    """CTE adding the WOE measures to a CTE of bin counts."""
    return (
        f'{name}_d AS (SELECT *, "DEFAULT" / "COUNT" AS "DEFAULT_RATE", "NONDEFAULT" / "COUNT" AS "NONDEFAULT_RATE", '
        '"DEFAULT" / sum("DEFAULT") OVER w AS "DIST_DEFAULT", "NONDEFAULT" / sum("NONDEFAULT") OVER w AS "NONDIST_DEFAULT" '
        f'FROM {source} WINDOW w AS (PARTITION BY "VARNAME")), '
        f'{name}_w AS (SELECT *, CASE WHEN "DIST_DEFAULT" = 0 AND "NONDIST_DEFAULT" = 0 THEN NULL '
        'WHEN "DIST_DEFAULT" = 0 OR "NONDIST_DEFAULT" = 0 THEN 0.0 '
        f'ELSE ln("NONDIST_DEFAULT" / "DIST_DEFAULT") END AS "WOE" FROM {name}_d), '
        f'{name} AS (SELECT *, sum(("NONDIST_DEFAULT" - "DIST_DEFAULT") * "WOE") OVER (PARTITION BY "VARNAME") AS "IV" '
        f"FROM {name}_w)"
    )


_ROUNDED = ", ".join(f'round("{m}", 6) AS "{m}"' for m in MEASURES)
_COUNTS = '"VARNAME", "COUNT", "DEFAULT", "NONDEFAULT", "MIN_VALUE", "MAX_VALUE"'


@query(
    "woe_numeric_bins",
    with_loans(
        'SELECT "VARNAME", CAST("BIN" AS BIGINT) AS "BIN", "MIN_VALUE", "MAX_VALUE", "COUNT", "DEFAULT" FROM nbins',
        sql_numeric_bins(NUMERIC, 10),
    ),
)
def woe_numeric_bins(spark, sf):
    edges, cells = woe.numeric_edges(loans(spark, sf), NUMERIC, "label", bins=10)
    bins = as_long(woe.numeric_bin_table(spark, edges, cells), "BIN")
    return bins.select("VARNAME", "BIN", "MIN_VALUE", "MAX_VALUE", "COUNT", "DEFAULT")


# The monotone search in full: every bin count from 20 down, ranks of the bin means, the largest
# count whose rank correlation is strong enough.
def _sql_search() -> str:
    edges = " UNION ALL ".join(
        f"SELECT '{c}' AS v, {n} AS n, quantile_cont({c}, [{', '.join(repr(i / n) for i in range(1, n))}]) AS edges FROM loans"
        for c in NUMERIC
        for n in range(2, 21)
    )
    long = " UNION ALL ".join(f"SELECT '{c}' AS v, {c} AS x, label AS y FROM loans WHERE {c} IS NOT NULL" for c in NUMERIC)
    return (
        f"edges AS ({edges}), "
        f"binned AS (SELECT v, n, len(list_filter(edges, lambda e: e < x)) AS bin, avg(x) AS mx, avg(y) AS my "
        f"FROM ({long}) JOIN edges USING (v) GROUP BY v, n, bin), "
        "ranked AS (SELECT v, n, rank() OVER (PARTITION BY v, n ORDER BY mx) AS rx, "
        "rank() OVER (PARTITION BY v, n ORDER BY my) + (count(*) OVER (PARTITION BY v, n, my) - 1) / 2.0 AS ry FROM binned), "
        "rho AS (SELECT v, n, corr(rx, ry) AS r FROM ranked GROUP BY v, n)"
    )


@query(
    "woe_bin_search",
    with_loans(
        'SELECT v AS "VARNAME", CAST(max(n) AS BIGINT) AS bins FROM rho WHERE abs(r) >= 0.8 GROUP BY v',
        _sql_search(),
    ),
)
def woe_bin_search(spark, sf):
    edges, cells = woe.numeric_edges(loans(spark, sf), NUMERIC, "label")
    table_ = woe.numeric_bin_table(spark, edges, cells).filter("BIN >= 0")
    return table_.groupBy("VARNAME").agg(F.count(F.lit(1)).alias("bins"))


@query(
    "woe_numeric",
    with_loans(
        f"SELECT {_COUNTS}, {_ROUNDED} FROM nwoe",
        sql_numeric_bins(NUMERIC, 5) + ", " + sql_measures("nbins", "nwoe"),
    ),
)
def woe_numeric(spark, sf):
    return rounded(woe.woe_numeric(loans(spark, sf), NUMERIC, "label", bins=5).drop("BIN"), *MEASURES)


@query(
    "woe_categorical",
    with_loans(
        f"SELECT {_COUNTS}, {_ROUNDED} FROM cwoe",
        sql_category_bins(CATEGORICAL) + ", " + sql_measures("cbins", "cwoe"),
    ),
)
def woe_categorical(spark, sf):
    return rounded(woe.woe_categorical(loans(spark, sf), CATEGORICAL, "label"), *MEASURES)


def _sql_iv(numeric, categorical, bins: int) -> str:
    return ", ".join(
        [
            sql_numeric_bins(numeric, bins),
            sql_measures("nbins", "nwoe"),
            sql_category_bins(categorical),
            sql_measures("cbins", "cwoe"),
            'iv AS (SELECT "VARNAME", max("IV") AS "IV" FROM (SELECT "VARNAME", "IV" FROM nwoe '
            'UNION ALL SELECT "VARNAME", "IV" FROM cwoe) GROUP BY 1)',
        ]
    )


@query(
    "iv_summary",
    with_loans(
        'SELECT "VARNAME", round("IV", 6) AS "IV" FROM iv ORDER BY "IV" DESC, "VARNAME"',
        _sql_iv(["price", "balance", "nation"], [*CATEGORICAL, "constant"], 5),
    ),
)
def iv_summary(spark, sf):
    columns = ["price", "balance", "nation", *CATEGORICAL, "constant"]
    model = woe.WoeBinner(columns, "label", bins=5).fit(loans(spark, sf))
    return rounded(model.iv(), "IV")


@query(
    "woe_apply",
    with_loans(
        "SELECT id, "
        + ", ".join(
            f"(SELECT round(\"WOE\", 6) FROM nwoe WHERE \"VARNAME\" = '{c}' AND \"BIN\" = CASE WHEN {c} IS NULL THEN -1 ELSE "
            f"len(list_filter((SELECT edges FROM edges WHERE v = '{c}'), lambda e: e < {c})) END) AS {c}_woe"
            for c in NUMERIC
        )
        + ", "
        + ", ".join(
            f"(SELECT round(\"WOE\", 6) FROM cwoe WHERE \"VARNAME\" = '{c}' AND \"MIN_VALUE\" IS NOT DISTINCT FROM {c}) AS {c}_woe"
            for c in CATEGORICAL
        )
        + " FROM loans",
        _sql_iv(NUMERIC, CATEGORICAL, 5),
    ),
)
def woe_apply(spark, sf):
    df = loans(spark, sf).select("id", "label", *NUMERIC, *CATEGORICAL)
    model = woe.WoeBinner([*NUMERIC, *CATEGORICAL], "label", bins=5).fit(df)
    names = [f"{c}_woe" for c in [*NUMERIC, *CATEGORICAL]]
    return rounded(model.transform(df).select("id", *names), *names)


@query("woe_tree_bins")
def woe_tree_bins(spark, sf):
    binner = woe.TreeWoeBinner([*NUMERIC, "nation", *CATEGORICAL], "label", min_gain=0.02)
    return binner.fit(loans(spark, sf)).table


@query(
    "var_filter",
    with_loans(
        'SELECT "VARNAME", round(missing / n, 6) AS missing_fraction, round(top / (n - missing), 6) AS dominant_share, '
        'round("IV", 6) AS iv, missing / n <= 0.5 AND top / (n - missing) <= 0.95 AND "IV" >= 0.0005 AS keep '
        "FROM iv JOIN common USING (\"VARNAME\"), (SELECT count(*) AS n FROM loans)",
        _sql_iv(["price", "sparse"], [*CATEGORICAL, "constant"], 5)
        + ", common AS (SELECT v AS \"VARNAME\", coalesce(sum(k) FILTER (WHERE x IS NULL), 0) AS missing, "
        "max(k) FILTER (WHERE x IS NOT NULL) AS top FROM (SELECT v, x, count(*) AS k FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS v, CAST({c} AS VARCHAR) AS x FROM loans"
            for c in ["price", "sparse", *CATEGORICAL, "constant"]
        )
        + ") GROUP BY v, x) GROUP BY v)",
    ),
)
def var_filter(spark, sf):
    columns = ["price", "sparse", *CATEGORICAL, "constant"]
    checked = woe.var_filter(
        loans(spark, sf), columns, "label", iv_limit=0.0005, missing_limit=0.5, bins=5
    )
    return rounded(checked, "missing_fraction", "dominant_share", "iv")


@query(
    "group_target_mean",
    with_loans(
        "SELECT priority, count(*) AS n, round(avg(label), 6) AS mean, round((SELECT avg(label) FROM loans), 6) AS global_mean "
        "FROM loans GROUP BY priority"
    ),
)
def group_target_mean(spark, sf):
    grouped = loans(spark, sf).groupBy("priority").agg(F.count("label").alias("n"), F.sum("label").alias("s"))
    whole = grouped.agg((F.sum("s") / F.sum("n")).alias("g"))
    return grouped.join(F.broadcast(whole)).select(
        "priority", "n", r6(F.col("s") / F.col("n")).alias("mean"), r6("g").alias("global_mean")
    )


@query(
    "target_profile",
    with_loans(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, round(corr({c}, label), 6) AS corr, "
            f"round(median({c}) FILTER (WHERE label = 0), 6) AS median_0, "
            f"round(median({c}) FILTER (WHERE label = 1), 6) AS median_1 FROM loans"
            for c in NUMERIC
        )
    ),
)
def target_profile(spark, sf):
    return rounded(profile.target_profile(loans(spark, sf), NUMERIC, "label"), "corr", "median_0", "median_1")


@query(
    "kde_by_class",
    with_loans(
        "SELECT label, step, round(lo + step * (hi - lo) / 99, 4) AS x, "
        "round(sum(rows * exp(-0.5 * pow((lo + step * (hi - lo) / 99 - (lo + (cell + 0.5) * (hi - lo) / 512)) / bw, 2))) "
        "/ (any_value(n) * any_value(bw) * sqrt(2 * pi())) * 1e6, 6) AS density_ppm "
        "FROM hist JOIN scale USING (label), b, (SELECT CAST(i AS INTEGER) AS step FROM range(100) t(i)) "
        "GROUP BY label, step, lo, hi",
        "u AS (SELECT label, price AS v FROM loans WHERE price IS NOT NULL), b AS (SELECT min(v) AS lo, max(v) AS hi FROM u), "
        "scale AS (SELECT label, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS bw FROM u GROUP BY label), "
        "hist AS (SELECT label, least(CAST(floor((v - lo) / ((hi - lo) / 512)) AS INTEGER), 511) AS cell, count(*) AS rows "
        "FROM u, b GROUP BY 1, 2)",
    ),
)
def kde_by_class(spark, sf):
    curve = profile.kde_by_class(loans(spark, sf), "price", "label", grid=100, cells=512)
    return curve.select("label", "step", F.round("x", 4).alias("x"), r6(F.col("density") * 1e6).alias("density_ppm"))


@query(
    "category_label_counts",
    with_loans(
        " UNION ALL ".join(
            f"SELECT '{c}' AS varname, {c} AS value, label, count(*) AS rows FROM loans GROUP BY ALL" for c in CATEGORICAL
        )
    ),
)
def category_label_counts(spark, sf):
    return profile.category_label_counts(loans(spark, sf), CATEGORICAL, "label")


@query(
    "scatter_sample",
    with_loans(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, id, {c} AS value, label FROM loans"
            for c in NUMERIC
        )
    ),
)
def scatter_sample(spark, sf):
    return profile.scatter_rows(loans(spark, sf), NUMERIC, "id", "label")


LINE_COLUMNS = [
    ("l_quantity", "quantity"),
    ("l_extendedprice", "gross"),
    ("l_extendedprice * (1 - l_discount)", "net"),
    ("l_extendedprice * (1 - l_discount) * (1 + l_tax)", "charged"),
    ("l_discount", "discount"),
    ("CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END", "tax"),
    ("-l_quantity", "returned"),
]
LINES_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for e, n in LINE_COLUMNS) + " FROM lineitem"
LINE_NAMES = [n for _, n in LINE_COLUMNS]


def lines(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for e, n in LINE_COLUMNS])


def _sql_pairs(condition: str | None = None) -> str:
    pairs = [
        (a, b) for i, a in enumerate(LINE_NAMES) for j, b in enumerate(LINE_NAMES) if i < j
    ]
    parts = " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, corr({a}, {b}) AS r FROM lines" for a, b in pairs)
    where = f" WHERE {condition}" if condition else ""
    return f"WITH lines AS ({LINES_SQL}) SELECT i, j, round(r, 6) AS r FROM ({parts}){where}"


@query("corr_matrix", _sql_pairs())
def corr_matrix(spark, sf):
    return rounded(profile.correlation_pairs(lines(spark, sf), LINE_NAMES), "r")


@query("high_corr_pairs", _sql_pairs("r >= 0.8"))
def high_corr_pairs(spark, sf):
    matrix = profile.correlation_matrix(lines(spark, sf), LINE_NAMES)
    partners = profile.high_corr(matrix)
    rows = [(a, b, float(matrix.loc[a, b])) for a, found in partners.items() for b in found]
    return rounded(spark.createDataFrame(rows, "i string, j string, r double"), "r")


@query(
    "drop_high_corr",
    f"WITH lines AS ({LINES_SQL}) SELECT quantity, charged, discount, tax, returned FROM lines",
)
def drop_high_corr(spark, sf):
    df = lines(spark, sf)
    return profile.drop_high_corr(df, LINE_NAMES).transform(df)


@query(
    "drop_corr_upper",
    f"WITH lines AS ({LINES_SQL}) SELECT quantity, gross, discount, tax FROM lines",
)
def drop_corr_upper(spark, sf):
    df = lines(spark, sf)
    return profile.drop_correlated(df, LINE_NAMES).transform(df)
