"""Fold assignment and sampling, a pure function of row id and seed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import hash_prefix, row_hash, running_row_numbers, shuffled_row_number


def hash_fold(df: DataFrame, id_col: str, folds: int = 5, seed: int = 10000, out: str = "fold") -> DataFrame:
    """Shuffled K folds, balanced in expectation; map-only."""
    return df.withColumn(out, F.pmod(hash_prefix(id_col, seed), F.lit(folds)).cast("int"))


def even_fold(df: DataFrame, id_col: str, folds: int = 5, seed: int = 10000, out: str = "fold") -> DataFrame:
    """Shuffled K folds whose sizes differ by at most one row."""
    numbered = shuffled_row_number(df, id_col, seed, out="_rn")
    return numbered.withColumn(out, F.pmod(F.col("_rn") - 1, F.lit(folds)).cast("int")).drop("_rn")


def stratified_fold(
    df: DataFrame, id_col: str, label: str, folds: int = 5, seed: int = 913100, out: str = "fold"
) -> DataFrame:
    """Shuffled K folds whose sizes differ by at most one row within every label."""
    numbered = shuffled_row_number(df, id_col, seed, by=[label], out="_rn")
    return numbered.withColumn(out, F.pmod(F.col("_rn") - 1, F.lit(folds)).cast("int")).drop("_rn")


def folds_of_folds(
    df: DataFrame, id_col: str, label: str, fold: str, outs: Mapping[int, str], folds: int = 5, seed: int = 913100
) -> DataFrame:
    """For every outer fold of ``outs`` a column with the :func:`stratified_fold` of the rows outside it, -1 for the others.

    All of them come from one shuffle.
    """
    numbers = {out: F.coalesce(F.col(fold) != k, F.lit(False)) for k, out in outs.items()}
    numbered = running_row_numbers(df, id_col, seed, [label], numbers)
    inner = {out: F.when(F.col(out) > 0, F.pmod(F.col(out) - 1, F.lit(folds))).otherwise(-1).cast("int") for out in numbers}
    return numbered.withColumns(inner)


def sample_rows(df: DataFrame, id_col: str, rows: int, seed: int = 0) -> DataFrame:
    """Exactly ``rows`` rows (or all, if fewer) with the smallest md5, then id.

    Only ids are numbered, to find the last row of the draw; the rows themselves are filtered and never
    shuffled.
    """
    if rows < 1:
        return df.limit(0)
    numbered = shuffled_row_number(df.select(id_col), id_col, seed, out="_rn")
    last = numbered.filter(F.col("_rn") == rows).select(row_hash(id_col, seed).alias("hash"), F.col(id_col).alias("id")).first()
    if last is None:
        return df
    ours = row_hash(id_col, seed)
    return df.filter((ours < last["hash"]) | ((ours == last["hash"]) & (F.col(id_col) <= F.lit(last["id"]))))


def hold_out(df: DataFrame, id_col: str, share: float = 0.2, seed: int = 0, out: str = "is_dev") -> DataFrame:
    """Flag about ``share`` of the rows as the development set."""
    cut = int(share * 2**32)
    return df.withColumn(out, hash_prefix(id_col, seed) < F.lit(cut))
