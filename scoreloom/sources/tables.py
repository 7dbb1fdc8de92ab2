"""Reading train / test pairs and pre-split folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEV_ROWS = 100


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, or CSV with a header and a declared schema (inferred only when none is given)."""
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return spark.read.parquet(path)


def first_rows(df: DataFrame, id_col: str, rows: int = DEV_ROWS) -> DataFrame:
    """The development sample: the rows with the smallest ids."""
    return df.orderBy(id_col).limit(rows)


def read_pair(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    schema: T.StructType | str | None = None,
    label: str = "label",
    dev_mode: bool = False,
    id_col: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """Training and test frames; the test file has the same columns but the label."""
    test_schema = schema
    if isinstance(schema, T.StructType):
        test_schema = T.StructType([f for f in schema.fields if f.name != label])
    frames = read_table(spark, train_path, schema), read_table(spark, test_path, test_schema)
    return tuple(first_rows(f, id_col) for f in frames) if dev_mode else frames


def read_folds(
    spark: SparkSession, dev_paths: Sequence[str], schema: T.StructType | str | None = None
) -> DataFrame:
    """One frame with a ``fold`` column from the development file of every fold.

    The training rows of fold k are ``fold != k``, so nothing is read or stored twice.
    """
    out = None
    for k, path in enumerate(dev_paths):
        part = read_table(spark, path, schema).withColumn("fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def fold_part(df: DataFrame, fold: int, dev: bool, fold_col: str = "fold") -> DataFrame:
    """Development (``dev``) or training rows of one fold."""
    return df.filter(F.col(fold_col) == fold if dev else F.col(fold_col) != fold)


def check_unique(df: DataFrame, id_col: str) -> None:
    """Raise when an id is missing or repeated."""
    bad = df.groupBy(id_col).count().filter((F.col("count") > 1) | F.col(id_col).isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"{id_col} is not a unique key, for example {bad[0][0]!r}")
