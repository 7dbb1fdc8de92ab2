"""Estimator and model bases.

A fitted model is a small dictionary of plain values (``info``) and a dictionary of
DataFrames (``tables``).  Both can be saved to and read back from a folder, so a model
learned on one cluster can be applied on another.
"""

from __future__ import annotations

import json

from pyspark.ml.base import Estimator, Model
from pyspark.sql import DataFrame, SparkSession


class TableEstimator(Estimator):
    """Estimator whose settings are ordinary attributes; works inside ``pyspark.ml.Pipeline``."""

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class TableModel(Model):
    """Fitted state made of ``info`` (JSON values) and ``tables`` (DataFrames)."""

    def __init__(self, info: dict | None = None, tables: dict[str, DataFrame] | None = None):
        super().__init__()
        self.info = dict(info or {})
        self.tables = dict(tables or {})

    def save(self, path: str) -> None:
        """Write the tables as parquet and the settings as one JSON line."""
        spark = SparkSession.getActiveSession()
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/tables/{name}")
        meta = {"info": self.info, "tables": sorted(self.tables)}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/meta")

    @classmethod
    def load(cls, path: str):
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        tables = {name: spark.read.parquet(f"{path}/tables/{name}") for name in meta["tables"]}
        return cls(meta["info"], tables)
