"""Numbers behind the usual exploratory charts, and correlation filters."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import long_categories
from .matrices import sum_arrays
from .missing import DropColumnsModel
from .ordering import exact_quantiles, hash_unit

def target_profile(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Per feature: correlation with the 0/1 label and the median within each class."""
    row = df.agg(
        *[_safe_corr(c, label).alias(f"r{i}") for i, c in enumerate(columns)]
    ).first()
    split = df.select(
        *[
            F.when(F.col(label) == k, F.col(f"`{c}`").cast("double")).alias(f"m{i}_{k}")
            for i, c in enumerate(columns)
            for k in (0, 1)
        ]
    )
    medians, _ = exact_quantiles(split, {c: [0.5] for c in split.columns})
    rows = [
        (c, row[f"r{i}"], medians[f"m{i}_0"][0.5], medians[f"m{i}_1"][0.5])
        for i, c in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(
        rows, "feature string, corr double, median_0 double, median_1 double"
    )


def kde_by_class(df: DataFrame, column: str, label: str, grid: int = 100, cells: int = 512) -> DataFrame:
    """Gaussian kernel density per class on an even grid: ``label, step, x, density``.

    The rows are first reduced to a histogram of ``cells`` equal-width cells; the kernel then
    works on cell centres, with Scott's bandwidth from the raw rows.
    """
    value = F.col(f"`{column}`").cast("double")
    used = df.filter(value.isNotNull() & F.col(label).isNotNull())
    stats = used.groupBy(label).agg(
        F.count(value).alias("n"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
    ).collect()
    low, high = min(r["lo"] for r in stats), max(r["hi"] for r in stats)
    width = (high - low) / cells
    if not width:
        raise ValueError(f"{column} has a single value; it has no density")
    scale = df.sparkSession.createDataFrame(
        [(r[label], r["n"], r["sd"] * r["n"] ** -0.2) for r in stats if r["sd"]],
        f"{label} {dict(df.dtypes)[label]}, n bigint, bandwidth double",
    )
    cell = F.least(F.floor((value - low) / width).cast("int"), F.lit(cells - 1))
    histogram = used.groupBy(label, cell.alias("cell")).agg(F.count(F.lit(1)).alias("rows"))
    step = (high - low) / (grid - 1)
    at = F.lit(low) + F.col("step") * F.lit(step)
    center = F.lit(low) + (F.col("cell") + 0.5) * F.lit(width)
    kernel = F.exp(-0.5 * F.pow((at - center) / F.col("bandwidth"), F.lit(2.0)))
    return (
        histogram.join(F.broadcast(scale), label)
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
        .groupBy(label, "step", "n", "bandwidth")
        .agg(F.sum(F.col("rows") * kernel).alias("mass"))
        .select(
            label,
            "step",
            at.alias("x"),
            (F.col("mass") / (F.col("n") * F.col("bandwidth") * math.sqrt(2 * math.pi))).alias("density"),
        )
    )


def category_label_counts(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Rows per ``(varname, value, label)`` for all category and boolean columns."""
    return (
        long_categories(df, columns, [label], none=False)
        .groupBy("varname", "value", label)
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def scatter_rows(
    df: DataFrame, columns: Sequence[str], id_col: str, label: str, fraction: float = 1.0, seed: int = 0
) -> DataFrame:
    """``feature, id, value, label`` of a hash sample of the rows, ordered by label."""
    picked = df if fraction >= 1 else df.filter(hash_unit(id_col, seed) < fraction)
    points = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value"))
            for c in columns
        ]
    )
    return (
        picked.select(id_col, label, F.explode(points).alias("_p"))
        .select("_p.feature", id_col, "_p.value", label)
        .orderBy(label, id_col, "feature")
    )


def _safe_corr(a: str, b: str):
    """Pearson correlation over complete pairs; NULL when one side is constant."""
    x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> pd.DataFrame:
    """Symmetric Pearson matrix over complete pairs; NaN when a side is constant.

    All pairs come from four matrix products per batch of rows, after a shift by the column
    means; a task sends its d x d sums once.
    """
    d = len(columns)
    numeric = [F.col(f"`{c}`").cast("double") for c in columns]
    row = df.agg(*[F.avg(c) for c in numeric]).first()
    shift = np.array([0.0 if m is None else m for m in row])

    def partial(x):
        x = x - shift
        seen = (~np.isnan(x)).astype(float)
        x = np.nan_to_num(x)
        return np.concatenate(
            [m.ravel() for m in (seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x)]
        )

    n, s, q, p = sum_arrays(df, numeric, 4 * d * d, partial).reshape(4, d, d)
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = p - s * s.T / n
        var = q - s * s / n
        matrix = cov / np.sqrt(var * var.T)
    matrix[(var <= 1e-12 * q) | (var.T <= 1e-12 * q.T)] = math.nan
    np.fill_diagonal(matrix, 1.0)
    return pd.DataFrame(matrix, list(columns), list(columns))


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form ``i, j, r`` for i before j."""
    matrix = correlation_matrix(df, columns).to_numpy()
    rows = [
        (a, b, None if math.isnan(matrix[i, j]) else float(matrix[i, j]))
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
        if i < j
    ]
    return df.sparkSession.createDataFrame(rows, "i string, j string, r double")


def _claimed(strong: np.ndarray) -> np.ndarray:
    """Which column claims which: its strong partners, save those that have claimed partners themselves.

    Columns claim in order, so a column can only be spared by one before it.
    """
    claims = strong & ~np.eye(len(strong), dtype=bool)
    for i in range(len(claims)):
        claims[i] &= ~_heads(claims, i)
    return claims


def _heads(claims: np.ndarray, before: int) -> np.ndarray:
    """Mask of the columns ahead of ``before`` that have claimed any partner."""
    heads = np.zeros(len(claims), dtype=bool)
    heads[:before] = claims[:before].any(axis=1)
    return heads


def high_corr(matrix: pd.DataFrame, threshold: float = 0.8) -> dict[str, list[str]]:
    """Partners of each column with correlation >= threshold.

    A column that already has partners of its own is not listed as another's partner.
    """
    claims = _claimed(matrix.to_numpy() >= threshold)
    return {c: list(matrix.columns[row]) for c, row in zip(matrix.columns, claims)}


def columns_to_drop(matrix: pd.DataFrame, threshold: float = 0.8) -> list[str]:
    """Drop the column with most partners, the first on ties, as long as any column has one."""
    strong = matrix.to_numpy() >= threshold
    alive, dropped = np.ones(len(strong), dtype=bool), []
    while (load := _claimed(strong & alive & alive[:, None]).sum(axis=1)).any():
        worst = int(load.argmax())
        alive[worst] = False
        dropped.append(matrix.columns[worst])
    return dropped


def drop_high_corr(df: DataFrame, columns: Sequence[str], threshold: float = 0.8) -> DropColumnsModel:
    """Model that drops columns by :func:`columns_to_drop`; one pass over the data."""
    return DropColumnsModel({"dropped": columns_to_drop(correlation_matrix(df, columns), threshold)})


def keep_uncorrelated(matrix: pd.DataFrame, threshold: float = 0.95, legacy: bool = False) -> list[str]:
    """Columns without an earlier column of absolute correlation >= threshold.

    ``legacy`` keeps a column when at least one earlier column is below the threshold.
    """
    size = matrix.abs().to_numpy()
    kept = []
    for j, name in enumerate(matrix.columns):
        earlier = size[:j, j]
        ok = bool((earlier < threshold).any()) if legacy else not bool((earlier >= threshold).any())
        if ok:
            kept.append(name)
    return kept


def drop_correlated(
    df: DataFrame, columns: Sequence[str], threshold: float = 0.95, legacy: bool = False
) -> DropColumnsModel:
    """Model that keeps only the columns of :func:`keep_uncorrelated`."""
    kept = keep_uncorrelated(correlation_matrix(df, columns), threshold, legacy)
    return DropColumnsModel({"dropped": [c for c in columns if c not in kept]})
