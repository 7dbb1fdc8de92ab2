"""Sums of small matrices over a large frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sum_arrays(
    df: DataFrame, columns: Sequence[Column], length: int, partial: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray:
    """Add up ``partial(block)`` -- ``length`` numbers per block of rows -- over the whole frame.

    Every task adds its blocks first and sends ``length`` numbers once; Spark adds the tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(length)
        for batch in batches:
            if len(batch):
                total += partial(batch.to_numpy(dtype=float))
        yield pd.DataFrame({"slot": np.arange(length), "value": total})

    rows = (
        df.select(*[c.alias(f"x{i}") for i, c in enumerate(columns)])
        .mapInPandas(run, "slot int, value double")
        .groupBy("slot")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    result = np.zeros(length)
    for r in rows:
        result[r["slot"]] = r["value"]
    return result
