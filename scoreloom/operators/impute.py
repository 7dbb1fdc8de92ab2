"""Column-mean and hot-deck imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..base import TableEstimator, TableModel
from ..functions.missing import is_missing
from .ordering import shuffled_row_number


class MeanImputerModel(TableModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                c: F.when(~is_missing(df, c, []), F.col(f"`{c}`").cast("double")).otherwise(F.lit(m))
                for c, m in self.info["means"].items()
            }
        )


class MeanImputer(TableEstimator):
    """Fills NULL and NaN with the column mean; 0 for a column without any value."""

    def __init__(self, columns: Sequence[str]):
        super().__init__()
        self.columns = list(columns)

    def _fit(self, df: DataFrame) -> MeanImputerModel:
        row = df.agg(
            *[
                F.avg(F.when(~is_missing(df, c, []), F.col(f"`{c}`").cast("double"))).alias(f"m{i}")
                for i, c in enumerate(self.columns)
            ]
        ).first()
        means = {c: row[f"m{i}"] for i, c in enumerate(self.columns)}
        return MeanImputerModel({"means": {c: 0.0 if m is None else m for c, m in means.items()}})


def hot_deck_fill(
    train: DataFrame, test: DataFrame, columns: Sequence[str], id_col: str, seed: int = 0
) -> DataFrame:
    """Fill NULLs of ``test`` from one randomly drawn ``train`` row per test row.

    Both frames are numbered in md5 order; test row r takes train row ``(r - 1) mod n + 1``,
    so every donor serves equally many rows and the join has no hot key.
    """
    donors = shuffled_row_number(train.select(id_col, *columns), id_col, seed, out="_rn")
    donors = donors.select(
        F.col("_rn").alias("_donor"), *[F.col(f"`{c}`").alias(f"_d_{c}") for c in columns]
    )
    rows = train.count()
    numbered = shuffled_row_number(test, id_col, seed, out="_rn").withColumn(
        "_donor", F.pmod(F.col("_rn") - 1, F.lit(rows)) + 1
    )
    return (
        numbered.join(donors, "_donor", "left")
        .withColumns({c: F.coalesce(F.col(f"`{c}`"), F.col(f"`_d_{c}`")) for c in columns})
        .drop("_rn", "_donor", *[f"_d_{c}" for c in columns])
    )
