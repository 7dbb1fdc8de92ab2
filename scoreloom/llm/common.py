"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.session import ensure_checkpoint_dir

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """``doc_id`` as long, ``text`` as string and the named extra columns, whatever else the table has."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name under ``spark.checkpoint.dir``, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def map_batches(df: DataFrame, work: Callable[[dict[str, list]], Iterable[dict[str, list]]], schema: str) -> DataFrame:
    """``df.mapInArrow`` for functions from one dict of columns to any number of them."""
    arrow = to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for columns in work(batch.to_pydict()):
                    yield pa.RecordBatch.from_pydict(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string of the simple types used here."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
        "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
        "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
    }
    return pa.schema([pa.field(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def unsigned_mod(column: Column, n: int) -> Column:
    """A hash column brought into 0 .. n-1."""
    return F.pmod(column, F.lit(n))
