"""Missing-value profile and the column filters learned from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..base import TableEstimator, TableModel
from ..functions.missing import RATE_PATTERNS, is_missing


def missing_table(
    df: DataFrame, patterns: Sequence = RATE_PATTERNS, columns: Sequence[str] | None = None
) -> DataFrame:
    """Missing cells per column: ``column, total_missing, missing_fraction``, worst first.

    One aggregation over the frame whatever the number of columns; only columns with at least
    one missing cell are listed.
    """
    columns = list(columns or df.columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.when(is_missing(df, c, patterns), 1)).alias(f"_m{i}") for i, c in enumerate(columns)],
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("total_missing"))
                for i, c in enumerate(columns)
            ]
        )
    )
    return (
        counted.select("_rows", rows.alias("_s"))
        .select("_s.*", (F.col("_s.total_missing") / F.col("_rows")).alias("missing_fraction"))
        .filter(F.col("total_missing") > 0)
        .orderBy(F.desc("missing_fraction"), "column")
    )


class DropColumnsModel(TableModel):
    """Drops the learned columns; columns a frame does not have are ignored."""

    @property
    def dropped(self) -> list[str]:
        return self.info["dropped"]

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.dropped)


class DropByMissingRate(TableEstimator):
    """Learns the columns whose missing fraction is at least ``rate``."""

    def __init__(self, rate: float, patterns: Sequence = RATE_PATTERNS, keep: Sequence[str] = ()):
        super().__init__()
        self.rate, self.patterns, self.keep = rate, list(patterns), list(keep)

    def _fit(self, df: DataFrame) -> DropColumnsModel:
        table = missing_table(df, self.patterns, [c for c in df.columns if c not in self.keep])
        bad = table.filter(F.col("missing_fraction") >= self.rate).collect()
        return DropColumnsModel({"dropped": [r["column"] for r in bad]})


class DropConstant(TableEstimator):
    """Learns the columns with at most one distinct value; NULL counts as a value.

    Minimum, maximum and number of NULLs are enough, so nothing is shuffled by value.
    """

    def __init__(self, columns: Sequence[str] | None = None):
        super().__init__()
        self.columns = list(columns) if columns else None

    def _fit(self, df: DataFrame) -> DropColumnsModel:
        columns = self.columns or df.columns
        exprs = []
        for i, c in enumerate(columns):
            value = F.col(f"`{c}`")
            one_value = F.coalesce(F.min(value) == F.max(value), F.lit(True))
            some_null = (F.count(value) > 0) & (F.count(value) < F.count(F.lit(1)))
            exprs.append((one_value & ~some_null).alias(f"c{i}"))
        row = df.agg(*exprs).first()
        return DropColumnsModel({"dropped": [c for i, c in enumerate(columns) if row[f"c{i}"]]})


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a NULL or NaN cell."""
    return df.na.drop("any", subset=list(columns) if columns else None)
