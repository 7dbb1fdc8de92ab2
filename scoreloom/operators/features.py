"""Numeric features: scaling, principal components, distances to cluster centres."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..base import TableEstimator, TableModel
from .kmeans import ManyStarts


class MinMaxModel(TableModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        scaled = {}
        for c, (low, high) in self.info["ranges"].items():
            value = F.col(f"`{c}`").cast("double")
            if low is None or high == low:
                scaled[c] = F.when(value.isNotNull(), F.lit(0.0))
            else:
                scaled[c] = (value - F.lit(low)) / F.lit(high - low)
        return df.withColumns(scaled)


class MinMaxScaler(TableEstimator):
    """Scales columns to [0, 1] by the training range; a constant column becomes 0."""

    def __init__(self, columns: Sequence[str]):
        super().__init__()
        self.columns = list(columns)

    def _fit(self, df: DataFrame) -> MinMaxModel:
        row = df.agg(
            *[F.min(F.col(f"`{c}`").cast("double")).alias(f"lo{i}") for i, c in enumerate(self.columns)],
            *[F.max(F.col(f"`{c}`").cast("double")).alias(f"hi{i}") for i, c in enumerate(self.columns)],
        ).first()
        return MinMaxModel(
            {"ranges": {c: [row[f"lo{i}"], row[f"hi{i}"]] for i, c in enumerate(self.columns)}}
        )


class PCAModelColumns(TableModel):
    """Adds ``pca_0 .. pca_k-1``; each component's largest loading is positive."""

    def _transform(self, df: DataFrame) -> DataFrame:
        means, loadings = self.info["means"], self.info["loadings"]
        columns = self.info["columns"]
        centered = [F.col(f"`{c}`").cast("double") - F.lit(m) for c, m in zip(columns, means)]
        scores = weighted_sums(F.array(*centered), loadings)
        return (
            df.withColumn("_pca", scores)
            .withColumns({f"pca_{i}": F.col("_pca")[i] for i in range(len(loadings))})
            .drop("_pca")
        )


class PCAFeatures(TableEstimator):
    """Smallest number of principal components keeping ``variance`` of the total variance."""

    def __init__(self, columns: Sequence[str], variance: float = 0.97):
        super().__init__()
        self.columns, self.variance = list(columns), variance

    def _fit(self, df: DataFrame) -> PCAModelColumns:
        vectors = VectorAssembler(inputCols=self.columns, outputCol="_raw").transform(df).select("_raw")
        scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=False).fit(vectors)
        model = PCA(k=len(self.columns), inputCol="_x", outputCol="_pc").fit(scaler.transform(vectors))
        share = np.array(model.explainedVariance.toArray())
        reached = np.cumsum(share) >= self.variance - 1e-12
        size = int(np.argmax(reached)) + 1 if reached.any() else len(share)
        loadings = model.pc.toArray().T[:size]
        top = loadings[np.arange(size), np.abs(loadings).argmax(axis=1)]
        loadings = loadings * np.sign(np.where(top == 0, 1.0, top))[:, None]
        return PCAModelColumns(
            {
                "columns": self.columns,
                "means": [float(m) for m in scaler.mean.toArray()],
                "loadings": loadings.tolist(),
                "explained": [float(s) for s in share],
            }
        )


def pca_block(columns: Sequence[str]) -> PCAFeatures:
    """All principal components: as many as there are columns of full rank."""
    return PCAFeatures(columns, 1.0)


def literal_matrix(rows: Sequence[Sequence[float]]) -> Column:
    """A constant array of arrays."""
    return F.from_json(F.lit(json.dumps([list(map(float, r)) for r in rows])), "array<array<double>>")


def weighted_sums(vector: Column, weights: Sequence[Sequence[float]]) -> Column:
    """Array of the dot products of an array column with every row of ``weights``."""
    return F.transform(
        literal_matrix(weights),
        lambda row: F.aggregate(
            F.zip_with(vector, row, lambda x, w: x * w), F.lit(0.0), lambda total, p: total + p
        ),
    )


def center_distances(vector: Column, centers: Sequence[Sequence[float]]) -> Column:
    """Array of Euclidean distances from an array column to each centre."""
    return F.transform(
        literal_matrix(centers),
        lambda center: F.sqrt(
            F.aggregate(
                F.zip_with(vector, center, lambda x, c: (x - c) * (x - c)),
                F.lit(0.0),
                lambda total, p: total + p,
            )
        ),
    )


class KMeansModel(TableModel):
    """Adds an array of distances to the learned centres."""

    def _transform(self, df: DataFrame) -> DataFrame:
        vector = F.array(*[F.col(f"`{c}`").cast("double") for c in self.info["columns"]])
        return df.withColumn(self.info["out"], center_distances(vector, self.info["centers"]))


class KMeansFeaturizer(TableEstimator):
    """Distances to k cluster centres, optionally found with a hint from the target.

    With ``target`` the clustering runs on the features and the scaled target together; the
    target coordinate is then dropped and one refinement step moves every centre to the mean of
    the rows nearest to it.
    """

    def __init__(
        self,
        columns: Sequence[str],
        k: int = 100,
        target: str | None = None,
        target_scale: float = 2.0,
        seeds: int = 20,
        max_iter: int = 20,
        seed: int = 0,
        out: str = "cluster_distance",
    ):
        super().__init__()
        self.columns, self.k, self.target, self.target_scale = list(columns), k, target, target_scale
        self.seeds, self.max_iter, self.seed, self.out = seeds, max_iter, seed, out

    def _fit(self, df: DataFrame) -> KMeansModel:
        inputs = [F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(self.columns)]
        if self.target:
            inputs.append((F.col(self.target) * F.lit(float(self.target_scale))).alias("_hint"))
        frame = df.select(*inputs)
        best, _ = ManyStarts(self.k, self.seeds, self.max_iter, seed=self.seed).fit(frame.select(F.array(*frame.columns).alias("x")))
        centers = best.tolist()
        if self.target:
            centers = self._refine(frame, [c[:-1] for c in centers])
        return KMeansModel({"columns": self.columns, "centers": centers, "out": self.out})

    def _refine(self, frame: DataFrame, centers: list[list[float]]) -> list[list[float]]:
        names = [c for c in frame.columns if c != "_hint"]
        distances = center_distances(F.array(*names), centers)
        nearest = (
            frame.withColumn("_d", distances)
            .withColumn("_cluster", F.array_position("_d", F.array_min("_d")))
            .groupBy("_cluster")
            .agg(*[F.avg(c).alias(c) for c in names])
            .collect()
        )
        moved = [list(c) for c in centers]
        for r in nearest:
            if r["_cluster"]:
                moved[r["_cluster"] - 1] = [r[c] for c in names]
        return moved


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Vector of numeric columns; NULL raises, so impute first."""
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def positive_probability(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[1]
