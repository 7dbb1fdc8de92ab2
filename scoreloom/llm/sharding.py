"""Jump consistent hashing: a stable key and the number of shards decide, without a table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.session import store

from .common import texts, unsigned_mod

NULL_KEY = -(2**63)
SLOT_ROWS = 50_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key.

    Each key walks through the shard counts at which it would move; the last below ``shards`` is its place.
    With one more shard a key either stays or moves into the new one.
    """
    state = keys.astype(np.int64).view(np.uint64).copy()
    place = np.zeros(len(state), np.int64)
    target = np.zeros(len(state), np.int64)
    walking = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(walking):
            place[walking] = target[walking]
            state[walking] = state[walking] * np.uint64(2862933555777941757) + np.uint64(1)
            draw = ((state[walking] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            target[walking] = ((place[walking] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            walking = walking[target[walking] < shards]
    return place


def jump_shard(key: Column, shards: int) -> Column:
    """Column form of :func:`jump`; a null key counts as the smallest long."""

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards).astype(np.int32))

    return of(F.coalesce(key.cast("long"), F.lit(NULL_KEY)))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Every row with its shard, its gapless slot there and its shard if there were one more.

    A null text has no bytes; a null ``doc_id`` is a key of its own.  Rows of one shard are numbered by a hash of
    the key, then by key and text; slots are counted in small sub-ranges of that hash first, so that no
    task numbers a whole shard.  Equal rows are interchangeable.
    """
    spark = docs.sparkSession
    rows = texts(docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(F.col("doc_id"), shards).alias("shard"),
        jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    rows = store(rows)
    parts = 1 + rows.count() // (shards * SLOT_ROWS)
    rows = rows.withColumn("part", unsigned_mod(F.xxhash64("doc_id", "text_crc32"), parts).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = starts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("base") + F.col("place")).alias("slot"), "grown_shard")
    )
