"""Registry of queries and the bindings of the library's inputs to the star-schema tables.

A binding is a list of ``(expression, name)`` pairs that Spark SQL and the checking engine read
alike, so both sides derive missing values, labels and categories in the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOAN_COLUMNS = [
    ("o_orderkey", "id"),
    ("CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END", "label"),
    ("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END", "price"),
    ("CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE c_acctbal END", "balance"),
    ("CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE c_nationkey END", "nation"),
    ("CASE WHEN o_orderkey % 11 = 0 THEN 'None' ELSE o_orderpriority END", "priority"),
    ("CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE c_mktsegment END", "segment"),
    ("CASE WHEN o_orderkey % 10 < 9 THEN NULL ELSE c_acctbal END", "sparse"),
    ("1", "constant"),
    ("o_totalprice", "amount"),
    ("c_acctbal", "funds"),
    ("floor((c_acctbal + 1000.0) / 110.0) / 100.0", "score"),
    ("'[''' || c_mktsegment || ''', ''' || o_orderpriority || ''', ''' || c_mktsegment || ''']'", "tags"),
]


def _select_list(columns) -> str:
    return ", ".join(f"{expression} AS {name}" for expression, name in columns)


LOANS_SQL = f"SELECT {_select_list(LOAN_COLUMNS)} FROM orders JOIN customer ON o_custkey = c_custkey"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer: id, 0/1 label, numeric and categorical features."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.selectExpr(*[f"{expression} AS {name}" for expression, name in LOAN_COLUMNS])


SPLIT_SEED, SPLIT_PARTS = 7, 5


def sql_fold(seed: int | str, parts: int, key: str = "id") -> str:
    return f"(CAST('0x' || substr(md5('{seed}|' || {key}), 1, 8) AS BIGINT) % {parts})"


def sql_even_fold(seed: int | str, parts: int, by: str, key: str = "id") -> str:
    return (
        f"((row_number() OVER (PARTITION BY {by} ORDER BY md5('{seed}|' || {key}), {key}) - 1) % {parts})"
    )


def loan_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training rows, and test rows in which one priority is renamed to an unseen one."""
    from ..operators.ordering import hash_prefix

    df = loans(spark, sf_dir)
    part = F.pmod(hash_prefix("id", SPLIT_SEED), F.lit(SPLIT_PARTS))
    test = df.filter(part == 0).withColumn(
        "priority", F.when(F.col("priority") == "5-LOW", "6-NEW").otherwise(F.col("priority"))
    )
    return df.filter(part != 0), test


PAIR_CTE = f"""loans AS ({LOANS_SQL}),
train AS (SELECT * FROM loans WHERE {sql_fold(SPLIT_SEED, SPLIT_PARTS)} <> 0),
test AS (SELECT * REPLACE (CASE WHEN priority = '5-LOW' THEN '6-NEW' ELSE priority END AS priority)
         FROM loans WHERE {sql_fold(SPLIT_SEED, SPLIT_PARTS)} = 0)"""


def with_loans(sql: str, more: str = "") -> str:
    return f"WITH loans AS ({LOANS_SQL}){', ' + more if more else ''} {sql}"


def with_pair(sql: str, more: str = "") -> str:
    return f"WITH {PAIR_CTE}{', ' + more if more else ''} {sql}"


def query(name: str, sql: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` and its SQL twin."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def r6(column: Column | str) -> Column:
    """Rounded to six places, for comparison across engines."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return reduce(lambda frame, n: frame.withColumn(n, r6(F.col(f"`{n}`"))), names, df)


def as_long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(f"`{n}`").cast("long") for n in names})
