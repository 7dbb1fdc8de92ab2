"""Synthetic minority oversampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .lookup import attach
from .neighbors import nearest_neighbors
from .ordering import shuffled_row_number


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def smote(
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    id_col: str,
    ratio: float = 0.25,
    k: int = 5,
    seed: int = 0,
) -> DataFrame:
    """Add synthetic rows of the smaller class until minority / majority reaches ``ratio``.

    Each lies between a minority row and one of its ``k`` nearest minority neighbours, both
    chosen by hash.  Returns ``id, label, columns, is_synthetic, copy``: a synthetic row carries
    its base row's id and a copy number from 1.  Equal minority points are searched once and
    count as each other's nearest neighbours.
    """
    real = df.select(
        id_col, label, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]
    )
    out = real.withColumns({"is_synthetic": F.lit(0), "copy": F.lit(0).cast("long")})
    sizes = {r[label]: r["rows"] for r in class_counts(df, label).collect() if r[label] is not None}
    minority, majority = min(sizes, key=sizes.get), max(sizes, key=sizes.get)
    wanted = int(ratio * sizes[majority]) - sizes[minority]
    if len(sizes) != 2 or wanted <= 0:
        return out
    if sizes[minority] < 2:
        raise ValueError("oversampling needs at least two rows of the smaller class")
    base = real.filter(F.col(label) == minority)
    gaps = base.agg(*[F.count(F.when(F.col(f"`{c}`").isNull() | F.isnan(f"`{c}`"), 1)).alias(c) for c in columns]).first()
    if empty := [c for c in columns if gaps[c]]:
        raise ValueError(f"oversampling needs complete rows; impute {', '.join(empty)} first")

    key = F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in columns])
    points = materialize(
        base.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_key", key)
    )
    near = nearest_neighbors(points, columns, "_key", "_n", k, seed)
    itself = points.filter(F.col("_n") > 1).select(
        F.col("_key").alias("key"),
        F.array(*columns).alias("neighbor"),
        (F.col("_n") - 1).alias("times"),
        F.lit(0.0).alias("distance"),
    )
    ranked = Window.partitionBy("key").orderBy("distance", F.desc("times"), "neighbor")
    upto = ranked.rowsBetween(Window.unboundedPreceding, 0)
    # At most k + 1 candidates per point; ``upto`` counts neighbours with their multiplicity.
    choices = (
        near.unionByName(itself)
        .withColumn("upto", F.sum("times").over(upto))
        .filter(F.col("upto") - F.col("times") < k)
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("upto", "neighbor"))).alias("_near"))
    )
    table = materialize(
        points.join(choices.withColumnRenamed("key", "_key"), "_key").select("_key", "_n", "_near")
    )
    each, extra = divmod(wanted, sizes[minority])
    numbered = shuffled_row_number(base, id_col, seed, out="_rn").withColumn("_key", key)
    copies = F.lit(each) + (F.col("_rn") <= extra).cast("int")
    drawn = (
        attach(numbered, table, ["_key"], weight="_n")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
        if each
        else attach(numbered.filter(F.col("_rn") <= extra), table, ["_key"], weight="_n").withColumn(
            "copy", F.lit(1).cast("long")
        )
    )
    token = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.col("copy").cast("string")))
    part = [F.conv(F.substring(token, a, 8), 16, 10).cast("long") for a in (1, 9)]
    available = F.least(F.lit(k).cast("long"), F.element_at("_near", -1)["upto"])
    index = F.pmod(part[0], available)
    partner = F.element_at(F.filter("_near", lambda c: c["upto"] > index), 1)["neighbor"]
    step = part[1] / F.lit(float(2**32))
    made = drawn.withColumns({"_partner": partner, "_step": step}).select(
        id_col,
        label,
        *[
            (F.col(f"`{c}`") + F.col("_step") * (F.col("_partner")[i] - F.col(f"`{c}`"))).alias(c)
            for i, c in enumerate(columns)
        ],
        F.lit(1).alias("is_synthetic"),
        "copy",
    )
    return out.unionByName(made)
