"""Left lookup joins that neither assume a small table nor suffer from a hot key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_width

BROADCAST_BYTES = 64 * 1024 * 1024
# A key holding at least 1/HOT_SHARE of the rows is hot.  Frequent-item sketches of TRACKED keys miss none of them and
# report none with less than half of that, so there are at most 2 * HOT_SHARE.
HOT_SHARE = 1000
TRACKED = 20 * HOT_SHARE


def _key_hash(df: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> Column:
    return F.xxhash64(*[df[f"`{k}`"].cast(kind) for k, kind in zip(keys, kinds)])


def hot_keys(df: DataFrame, keys: Sequence[str], kinds: Sequence[str] | None = None) -> list[int]:
    """Hashes of the keys that hold at least 1/HOT_SHARE of the rows of ``df`` (and perhaps of some that hold half of it).

    One pass over the key columns: every task counts its frequent keys in a sketch of fixed size, groups of
    tasks merge theirs, then the groups.  At most ``2 * HOT_SHARE`` numbers reach the driver.
    """
    kinds = kinds or [dict(df.dtypes)[k] for k in keys]
    parts = (
        df.select((F.spark_partition_id() % shuffle_width(df.sparkSession)).alias("_group"), _key_hash(df, keys, kinds).alias("_h"))
        .groupBy("_group")
        .agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(_h, {TRACKED})").alias("s"))
    )
    whole = parts.groupBy(F.lit(0).alias("_all")).agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(s, {TRACKED})").alias("s"))
    row = whole.select("n", F.expr(f"approx_top_k_estimate(s, {2 * HOT_SHARE})").alias("top")).first()
    return [] if row is None else [r["item"] for r in row["top"] if r["count"] * 2 * HOT_SHARE >= row["n"]]


def estimated_bytes(table: DataFrame) -> int:
    """Measured size of a table: text lengths plus 16 bytes per cell."""
    text = [
        F.coalesce(F.length(F.col(name).cast("string")), F.lit(0))
        for name, kind in table.dtypes
        if kind == "string" or kind.startswith("array")
    ]
    per_row = F.lit(16 * len(table.columns)) + sum(text, F.lit(0))
    return int(table.agg(F.sum(per_row.cast("long"))).first()[0] or 0)


def attach(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    weight: str | None = None,
    limit_bytes: int = BROADCAST_BYTES,
    measured: int | None = None,
) -> DataFrame:
    """Left join ``df`` to ``table`` on ``keys`` (null-safe); ``table`` has one row per key.

    ``table`` should be materialised state; its column ``weight``, if named, is left out.  Its size is measured (or
    given, when it was measured at fit time): up to ``limit_bytes`` it is broadcast, so ``df`` is not shuffled.
    Beyond that the hot keys of ``df`` itself are found by :func:`hot_keys`.  Their table rows are broadcast, and
    only the long tail goes through a shuffle join.  Rows of hot keys are spread over its tasks by a hash of the
    whole row, also those whose key the table does not hold.
    """
    values = [c for c in table.columns if c not in keys and c != weight]
    size = estimated_bytes(table) if measured is None else measured
    if size <= limit_bytes:
        return _left_join(df, F.broadcast(table.select(*keys, *values)), keys, values)
    kinds = [dict(df.dtypes)[k] for k in keys]
    other = [dict(table.dtypes)[k] for k in keys]
    if kinds != other:
        raise ValueError(f"the keys are {kinds} in the rows and {other} in the table; cast them alike")
    hashes = hot_keys(df, keys, kinds)
    if not hashes:
        return _left_join(df, table.select(*keys, *values), keys, values)
    hot_row = _key_hash(table, keys, kinds).isin(hashes)
    hot = table.filter(hot_row).select(*keys, F.struct(*values).alias("_hot"))
    cold = table.filter(~hot_row).select(*keys, F.struct(*values).alias("_cold"))
    tagged = _left_join(df.withColumn("_is_hot", _key_hash(df, keys, kinds).isin(hashes)), F.broadcast(hot), keys, ["_hot"])
    # Hot rows get a negative salt: it matches no table row, and it scatters them over tasks.
    row_salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(2**31))
    tagged = tagged.withColumn("_spread", F.when(F.col("_is_hot"), -1 - row_salt).otherwise(0))
    cold = cold.withColumn("_spread", F.lit(0).cast("long"))
    joined = _left_join(tagged, cold, [*keys, "_spread"], ["_cold"])
    picked = [
        F.when(F.col("_is_hot"), F.col("_hot")[v]).otherwise(F.col("_cold")[v]).alias(v)
        for v in values
    ]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *picked)


def _left_join(df: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    right = table.select(
        *[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)],
        *[F.col(f"`{v}`") for v in values],
    )
    on = reduce(
        lambda a, b: a & b,
        [F.col(f"`{k}`").eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)],
    )
    return df.join(right, on, "left").drop(*[f"_key{i}" for i in range(len(keys))])
