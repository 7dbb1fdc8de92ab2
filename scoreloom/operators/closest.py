"""Global closest-fit imputation without comparing pairs of rows.

A donor must equal the row on every attribute both know, so the distance -- one per attribute
unknown to either -- only depends on which attributes the two know.  Rows are reduced to
signatures (known values); for every kind of recipient, donors are reduced to the smallest id
per combination of shared attributes; recipients then look that table up by equality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .lookup import attach


def closest_fit(df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """``df`` with NULLs filled from the closest row, and that row's id as ``closest_id``.

    Among equally close rows the smallest id is taken.  A cell the donor does not know either,
    and rows without any candidate, stay as they are.  Complete rows get no ``closest_id``.
    """
    values = [f"_v{i}" for i in range(len(columns))]
    shared = [f"_k{i}" for i in range(len(columns))]
    mask = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in columns])
    rows = df.select(
        F.col(id_col).alias("_id"),
        mask.alias("_mask"),
        *[F.col(f"`{c}`").alias(v) for c, v in zip(columns, values)],
    )
    signature = ["_mask", *values]
    signatures = materialize(
        rows.groupBy(*signature).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    )
    incomplete = F.col("_mask").contains("0")
    kinds = [r["_mask"] for r in signatures.filter(incomplete).select("_mask").distinct().collect()]
    if not kinds:
        return df.withColumn("closest_id", F.lit(None).cast(dict(df.dtypes)[id_col]))

    # Donors of another kind: smallest id per recipient kind and values known to both.
    exploded = signatures.withColumn("_kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    donors = materialize(
        exploded.filter(F.col("_kind") != F.col("_mask"))
        .select("_kind", "_first", *_common("_kind", values, shared))
        .groupBy("_kind", *shared)
        .agg(F.min("_first").alias("_other"))
    )
    pattern = F.concat(*[F.when(F.col(k).isNull(), "0").otherwise("1") for k in shared])
    patterns = donors.select(F.col("_kind").alias("_mask"), pattern.alias("_pattern")).distinct()
    asked = (
        signatures.filter(incomplete)
        .join(patterns, "_mask")
        .withColumn("_kind", F.col("_mask"))
        .select(*signature, "_kind", "_pattern", *_common("_pattern", values, shared))
    )
    distance = F.length(F.regexp_replace("_pattern", "1", ""))
    # How often each key is asked for: tells hot keys, and drops donors nobody asks for.
    key = ["_kind", *shared]
    demand = asked.groupBy(*key).agg(F.count(F.lit(1)).alias("_asked"))
    offered = materialize(_join_safe(demand, donors, key, ["_other"]))
    best = (
        attach(asked, offered, key, weight="_asked")
        .filter(F.col("_other").isNotNull())
        .groupBy(*signature)
        .agg(F.min(F.struct(distance.alias("distance"), F.col("_other").alias("id"))).alias("_best"))
    )
    # Rows of the same kind with the same values: the two smallest ids suffice to skip oneself.
    order = Window.partitionBy(*signature).orderBy("_id")
    second = (
        rows.filter(incomplete)
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= 2)
        .groupBy(*signature)
        .agg(F.max(F.when(F.col("_rank") == 2, F.col("_id"))).alias("_second"))
    )
    state = materialize(
        _join_safe(
            _join_safe(signatures.filter(incomplete), second, signature, ["_second"]),
            best,
            signature,
            ["_best"],
        )
    )
    tagged = attach(rows.filter(incomplete), state, signature, weight="_n")
    own = F.when(F.col("_id") == F.col("_first"), F.col("_second")).otherwise(F.col("_first"))
    unknown = F.length(F.regexp_replace("_mask", "1", ""))
    own_pair = F.when(own.isNotNull(), F.struct(unknown.alias("distance"), own.alias("id")))
    chosen = F.least(own_pair, F.col("_best"))["id"]
    picks = materialize(tagged.select("_id", chosen.alias("_donor")).filter(F.col("_donor").isNotNull()))

    # Fetch each used donor once, then hand it out; a popular donor is a hot key of that join.
    used = picks.groupBy(F.col("_donor").alias("_id")).agg(F.count(F.lit(1)).alias("_uses"))
    given = materialize(
        rows.join(used, "_id").select(
            F.col("_id").alias("_donor"), "_uses", *[F.col(v).alias(f"_g{v}") for v in values]
        )
    )
    cells = attach(picks, given, ["_donor"], weight="_uses")
    filled = df.join(cells.withColumnRenamed("_id", "_rid"), F.col(id_col) == F.col("_rid"), "left")
    return (
        filled.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.col(f"_g{v}")) for c, v in zip(columns, values)})
        .withColumn("closest_id", F.col("_donor"))
        .drop("_rid", "_donor", *[f"_g{v}" for v in values])
    )


def _common(known_by: str, values: Sequence[str], shared: Sequence[str]) -> list[Column]:
    """Values kept where the other side's mask has a 1."""
    return [
        F.when(F.substring(F.col(known_by), i + 1, 1) == "1", F.col(v)).alias(s)
        for i, (v, s) in enumerate(zip(values, shared))
    ]


def _join_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], take: Sequence[str]) -> DataFrame:
    """Left join on null-safe keys, one row per key on both sides."""
    other = right.select(*[F.col(k).alias(f"_r{k}") for k in keys], *take)
    on = [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys]
    return left.join(other, on, "left").drop(*[f"_r{k}" for k in keys])
