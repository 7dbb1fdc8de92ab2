"""Sources, missing values, projections, text and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import missing as fm
from ..functions import text as ft
from ..functions import values as fv
from ..operators import encode, missing, select, split
from ..session import shared_path
from ..sources import sinks, tables
from .base import as_long, loan_pair, loans, query, sql_fold, table, with_loans, with_pair

FEATURES = ["price", "balance", "nation", "priority", "segment", "sparse", "constant"]


@query(
    "scan_dev_sample",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100",
)
def scan_dev_sample(spark, sf):
    return tables.first_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query(
    "fold_read",
    with_loans(f"SELECT id, label, price FROM loans WHERE {sql_fold(10000, 5)} <> 2"),
)
def fold_read(spark, sf):
    folded = split.hash_fold(loans(spark, sf), "id", 5, 10000)
    return tables.fold_part(folded, 2, dev=False).select("id", "label", "price")


@query(
    "dump_frames",
    with_loans(f"SELECT id, label, price, priority, CAST({sql_fold(10000, 5)} AS INTEGER) AS fold, 'night' AS run FROM loans"),
)
def dump_frames(spark, sf):
    """The folded table as one committed run, written twice; the second time adds nothing."""
    folded = split.hash_fold(loans(spark, sf).select("id", "label", "price", "priority"), "id", 5, 10000)
    path = shared_path(spark, "dump")
    for _ in range(2):
        sinks.commit_frame(folded, path, "night", by=["fold"])
    return sinks.read_committed(spark, path)


@query("submission", with_loans("SELECT id + 30000 AS id, score AS label FROM loans"))
def submission(spark, sf):
    return sinks.submission(loans(spark, sf))


@query(
    "submission_check",
    with_loans(
        "SELECT coalesce(a.id, b.id) AS id, coalesce(n, 0) AS submitted_rows, coalesce(m, 0) AS sample_rows "
        "FROM (SELECT id + 30000 AS id, count(*) AS n FROM loans GROUP BY 1) a FULL JOIN "
        "(SELECT l_orderkey + 30000 AS id, count(DISTINCT l_orderkey) AS m FROM lineitem GROUP BY 1) b "
        "ON a.id = b.id WHERE coalesce(n, 0) <> coalesce(m, 0)"
    ),
)
def submission_check(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    sample = lines.select(F.col("id"), F.lit(0.0).alias("score"))
    return sinks.submission_check(sinks.submission(loans(spark, sf)), sinks.submission(sample))


@query("eval_preds", with_loans("SELECT id, label, score AS y_pred FROM loans"))
def eval_preds(spark, sf):
    df = loans(spark, sf)
    return sinks.eval_predictions(df.select("id", "score"), df.drop("score"))


@query(
    "is_missing_filter",
    with_loans("SELECT id FROM loans WHERE price IS NULL OR priority IS NULL OR priority IN ('None', 'na', 'Nan', 'NaN')"),
)
def is_missing_filter(spark, sf):
    df = loans(spark, sf)
    return df.filter(fm.is_missing(df, "price") | fm.is_missing(df, "priority")).select("id")


_MISSING_PARTS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL"
    + (f" OR {c} = 'None'" if c in ("priority", "segment") else "")
    + ") AS total_missing, count(*) AS n FROM loans"
    for c in FEATURES
)


@query(
    "missing_table",
    with_loans(
        "SELECT \"column\", total_missing, round(total_missing / n, 6) AS missing_fraction "
        f"FROM ({_MISSING_PARTS}) WHERE total_missing > 0 ORDER BY missing_fraction DESC, 1"
    ),
)
def missing_table(spark, sf):
    found = missing.missing_table(loans(spark, sf).select(*FEATURES))
    return found.withColumn("missing_fraction", F.round("missing_fraction", 6))


@query(
    "drop_by_missing_rate",
    with_loans("SELECT id, label, price, balance, nation, priority, segment, constant FROM loans"),
)
def drop_by_missing_rate(spark, sf):
    df = loans(spark, sf).select("id", "label", *FEATURES)
    return missing.DropByMissingRate(0.8, keep=["id", "label"]).fit(df).transform(df)


@query(
    "replace_values",
    with_loans(
        "SELECT id, CASE WHEN priority IN ('None', '5-LOW') THEN 'other' ELSE priority END AS priority, "
        "CASE WHEN nation IN (3, 4) OR nation IS NULL THEN -1 ELSE nation END AS nation FROM loans"
    ),
)
def replace_values(spark, sf):
    df = loans(spark, sf)
    return df.select(
        "id",
        fm.replace_values(df, "priority", ["None", "5-LOW"], "other").alias("priority"),
        fm.replace_values(df, "nation", [3, 4, None], -1).alias("nation"),
    )


@query(
    "sentinel_to_null",
    with_loans("SELECT id, nullif(priority, 'None') AS priority, segment, nation FROM loans"),
)
def sentinel_to_null(spark, sf):
    return fm.null_out(loans(spark, sf).select("id", "priority", "segment", "nation"), skip=["id"])


@query(
    "complete_cases",
    with_loans(
        "SELECT id, price, balance, segment FROM loans "
        "WHERE price IS NOT NULL AND balance IS NOT NULL AND segment IS NOT NULL"
    ),
)
def complete_cases(spark, sf):
    return missing.complete_cases(loans(spark, sf).select("id", "price", "balance", "segment"))


@query(
    "ismiss_features",
    with_loans(
        "SELECT id, " + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}_ismiss" for c in FEATURES) + " FROM loans"
    ),
)
def ismiss_features(spark, sf):
    df = loans(spark, sf)
    return df.select("id", *[e.alias(n) for n, e in fm.indicators(df, FEATURES).items()])


@query("drop_constant", with_loans("SELECT id, price, segment, sparse FROM loans"))
def drop_constant(spark, sf):
    df = loans(spark, sf).select("id", "price", "segment", "sparse", "constant")
    return missing.DropConstant().fit(df).transform(df)


@query(
    "incomplete_count",
    with_loans(
        "SELECT id, CAST(" + " + ".join(f"({c} IS NULL)::INTEGER" for c in FEATURES) + " AS INTEGER) AS incomplete FROM loans"
    ),
)
def incomplete_count(spark, sf):
    return loans(spark, sf).select("id", fm.missing_count(FEATURES).alias("incomplete"))


@query(
    "value_whitelist",
    with_loans("SELECT id, CASE WHEN nation IN (1, 2, 3, 4, 6) THEN nation END AS nation FROM loans"),
)
def value_whitelist(spark, sf):
    return loans(spark, sf).select("id", fm.keep_listed(F.col("nation"), [1, 2, 3, 4, 6]).alias("nation"))


@query(
    "bulk_rename",
    'SELECT o_orderkey AS id, o_totalprice AS "1", o_orderstatus AS "2", o_orderpriority AS "3" FROM orders',
)
def bulk_rename(spark, sf):
    raw = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", "o_totalprice AS FIELD_1", "o_orderstatus AS FIELD_2", "o_orderpriority AS FIELD_3"
    )
    return fv.number_columns(raw)


@query(
    "cast_numeric",
    with_loans("SELECT id, CAST(label AS DOUBLE) AS label, price, CAST(nation AS DOUBLE) AS nation, priority FROM loans"),
)
def cast_numeric(spark, sf):
    return fv.cast_numeric(loans(spark, sf).select("id", "label", "price", "nation", "priority"), skip=["id"])


@query("project_selected", with_loans("SELECT price, nation FROM loans"))
def project_selected(spark, sf):
    df = loans(spark, sf).drop("label")
    numeric = fv.type_groups(df)["numerical"]
    return df.select(*[c for c in numeric if c in ("price", "nation")])


@query("coalesce_sources", with_loans("SELECT id, coalesce(balance, price) AS age FROM loans"))
def coalesce_sources(spark, sf):
    return loans(spark, sf).select("id", F.coalesce("balance", "price").alias("age"))


@query(
    "composite_key",
    with_loans("SELECT id, coalesce(segment, 'unk_segment') || ' - ' || priority AS district FROM loans"),
)
def composite_key(spark, sf):
    filled = ft.fill_unknown(F.col("segment"), "segment")
    return loans(spark, sf).select("id", fv.composite([filled, F.col("priority")]).alias("district"))


@query(
    "replace_all",
    with_loans("SELECT id, replace(replace(replace(priority, '-', ' '), 'MEDIUM', 'M'), ' ', '_') AS priority FROM loans"),
)
def replace_all(spark, sf):
    steps = {"-": " ", "MEDIUM": "M", " ": "_"}
    return loans(spark, sf).select("id", ft.replace_all(F.col("priority"), steps).alias("priority"))


@query(
    "normalize_name",
    "SELECT doc_id, replace(replace(replace(replace(strip_accents(translate(lower(text), 'đ', 'd')), ' ', ''), "
    "'y', 'i'), '.', ''), '-', '') AS name FROM documents",
)
def normalize_name(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ft.normalize_name(F.col("text")).alias("name"))


@query(
    "fill_unknown",
    with_loans(
        "SELECT id, coalesce(nullif(priority, 'None'), 'unk_priority') AS priority, "
        "lower(coalesce(segment, 'unk_segment')) AS segment FROM loans"
    ),
)
def fill_unknown(spark, sf):
    return loans(spark, sf).select(
        "id",
        ft.fill_unknown(F.col("priority"), "priority").alias("priority"),
        F.lower(ft.fill_unknown(F.col("segment"), "segment")).alias("segment"),
    )


_SQL_TAGS = "string_split(replace(replace(replace(tags, '[', ''), ']', ''), '''', ''), ', ')"


@query(
    "parse_list",
    with_loans(f"SELECT id, CAST(i AS BIGINT) AS place, {_SQL_TAGS}[i] AS item FROM loans, range(1, 4) AS t(i)"),
)
def parse_list(spark, sf):
    parsed = loans(spark, sf).select("id", ft.parse_list(F.col("tags")).alias("items"))
    return as_long(
        parsed.select("id", F.posexplode("items").alias("place", "item")).withColumn("place", F.col("place") + 1),
        "place",
    )


@query("array_count", with_loans(f"SELECT id, CAST(len({_SQL_TAGS}) AS BIGINT) AS tag_count FROM loans"))
def array_count(spark, sf):
    return loans(spark, sf).select("id", F.size(ft.parse_list(F.col("tags"))).cast("long").alias("tag_count"))


_TAG_VALUES = [
    "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW",
    "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY",
]


@query(
    "array_element_counts",
    with_pair(
        "SELECT id, "
        + ", ".join(
            f"CAST(len(list_filter({_SQL_TAGS}, lambda x: x = '{v}')) AS BIGINT) AS \"tag_count_{v}\"" for v in _TAG_VALUES
        )
        + " FROM test"
    ),
)
def array_element_counts(spark, sf):
    train, test = (d.withColumn("items", ft.parse_list(F.col("tags"))) for d in loan_pair(spark, sf))
    shared = encode.shared_categories(
        train.select(F.explode("items").alias("e")), test.select(F.explode("items").alias("e")), "e"
    )
    elements = sorted(r["e"] for r in shared.collect())
    return test.select(
        "id",
        *[ft.element_count(F.col("items"), e).cast("long").alias(f"tag_count_{e}") for e in elements],
    )


@query(
    "ordinal_map",
    with_loans(
        "SELECT id, CASE priority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 "
        "WHEN '5-LOW' THEN 0 ELSE -1 END AS priority FROM loans"
    ),
)
def ordinal_map(spark, sf):
    ranks = {"1-URGENT": 4, "2-HIGH": 3, "3-MEDIUM": 2, "5-LOW": 0}
    return loans(spark, sf).select("id", fv.map_values(F.col("priority"), ranks, -1).alias("priority"))


_TENURE_SQL = (
    "CASE WHEN days IN (0, -1) THEN 0 "
    + " ".join(
        f"WHEN abs(days - {int(365.25 * i) - 13}) <= 30 THEN {min(12, i)}" for i in range(1, 23)
    )
    + " ELSE -999 END"
)


@query(
    "tenure_bucket",
    f"SELECT doc_id, {_TENURE_SQL} AS years FROM (SELECT doc_id, n_chars AS days FROM documents)",
)
def tenure_bucket(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fv.tenure_year(F.col("n_chars")).alias("years"))


@query(
    "union_is_train",
    with_pair(
        "SELECT id, price, segment, 1 AS is_train FROM train UNION ALL "
        "SELECT id, price, segment, 0 AS is_train FROM test"
    ),
)
def union_is_train(spark, sf):
    train, test = (d.select("id", "price", "segment") for d in loan_pair(spark, sf))
    return select.union_is_train(train, test)


@query(
    "category_intersect",
    with_pair("SELECT priority FROM train INTERSECT SELECT priority FROM test"),
)
def category_intersect(spark, sf):
    train, test = loan_pair(spark, sf)
    return encode.shared_categories(train, test, "priority")


@query(
    "unseen_category",
    with_pair(
        "SELECT id, CASE WHEN priority NOT IN (SELECT priority FROM train) THEN 'unk_priority' "
        "ELSE priority END AS priority FROM test"
    ),
)
def unseen_category(spark, sf):
    train, test = loan_pair(spark, sf)
    return encode.mask_unseen(train, test, "priority", "unk_priority").select("id", "priority")


@query(
    "unseen_values",
    with_pair("SELECT priority FROM test EXCEPT SELECT priority FROM train"),
)
def unseen_values(spark, sf):
    train, test = loan_pair(spark, sf)
    return encode.unseen_categories(train, test, "priority")


@query(
    "zip_by_id",
    with_loans(
        "SELECT id, price, segment, CAST(price IS NULL AS INTEGER) AS price_ismiss, "
        "CAST(segment IS NULL AS INTEGER) AS segment_ismiss FROM loans"
    ),
)
def zip_by_id(spark, sf):
    df = loans(spark, sf).select("id", "price", "segment")
    return df.withColumns(fm.indicators(df, ["price", "segment"]))


@query("kfold_assign", with_loans(f"SELECT id, CAST({sql_fold(10000, 5)} AS INTEGER) AS fold FROM loans"))
def kfold_assign(spark, sf):
    return split.hash_fold(loans(spark, sf).select("id"), "id", 5, 10000)


@query(
    "even_kfold",
    with_loans(
        "SELECT id, CAST((row_number() OVER (ORDER BY md5('10000|' || id), id) - 1) % 5 AS INTEGER) AS fold FROM loans"
    ),
)
def even_kfold(spark, sf):
    return split.even_fold(loans(spark, sf).select("id"), "id", 5, 10000)


@query(
    "stratified_kfold",
    with_loans(
        "SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('913100|' || id), id) - 1) % 5 "
        "AS INTEGER) AS fold FROM loans"
    ),
)
def stratified_kfold(spark, sf):
    return split.stratified_fold(loans(spark, sf).select("id", "label"), "id", "label")


@query(
    "sample_rows",
    with_loans("SELECT id, price FROM loans ORDER BY md5('3|' || id), id LIMIT 1000"),
)
def sample_rows(spark, sf):
    return split.sample_rows(loans(spark, sf).select("id", "price"), "id", 1000, 3)


@query("hold_out", with_loans("SELECT id, CAST('0x' || substr(md5('5|' || id), 1, 8) AS BIGINT) < 858993459 AS is_dev FROM loans"))
def hold_out(spark, sf):
    return split.hold_out(loans(spark, sf).select("id"), "id", 0.2, 5)
