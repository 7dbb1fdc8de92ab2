"""Writing frames, submissions, evaluation predictions and tuning results."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_frame(df: DataFrame, path: str, fmt: str = "parquet", by_fold: bool = False) -> None:
    """Overwrite a folder with the frame, optionally one sub-folder per fold."""
    writer = df.write.mode("overwrite")
    if by_fold:
        writer = writer.partitionBy("fold")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def _files(spark: SparkSession, path: str):
    """The file system that holds ``path``, and a function from text to its path objects."""
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark._jsc.hadoopConfiguration()), to_path


def _lists(spark: SparkSession, path: str) -> DataFrame | None:
    """One row ``run, folder, schema`` per committed run; None before the first."""
    files, to_path = _files(spark, path)
    if not files.exists(to_path(f"{path}/runs")):
        return None
    return spark.read.schema("run string, folder string, schema string").json(f"{path}/runs")


def commit_frame(df: DataFrame, path: str, run: str, by: Sequence[str] = ()) -> bool:
    """Write a frame as the run ``run`` of the data set at ``path``; True if this call added it.

    Every attempt writes a folder of its own.  One small file that names the folder is then renamed into
    ``runs``, which commits the run.  What a failed attempt left behind is never read, and a run that is
    repeated after its commit adds nothing.  Run names are letters, digits, ``.``, ``_`` and ``-``.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", run):
        raise ValueError(f"{run!r} cannot be the name of a run")
    spark = df.sparkSession
    files, to_path = _files(spark, path)
    listed = to_path(f"{path}/runs/{run}.json")
    if files.exists(listed):
        return False
    attempt = uuid.uuid4().hex
    folder = f"data/{attempt}"
    df.write.partitionBy(*by).parquet(f"{path}/{folder}")
    draft = to_path(f"{path}/runs/_{attempt}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps({"run": run, "folder": folder, "schema": df.schema.json()}) + "\n", "utf-8"))
    out.close()
    # Another attempt of the same run may have come first; its rows stay.
    added = not files.exists(listed) and files.rename(draft, listed)
    if not added:
        files.delete(draft, False)
        files.delete(to_path(f"{path}/{folder}"), True)
    return bool(added)


def read_committed(spark: SparkSession, path: str, runs: Sequence[str] | None = None) -> DataFrame:
    """Rows of the committed runs (or of those named), each with its ``run``; an unknown run raises."""
    lists = _lists(spark, path)
    found = {r["run"]: r for r in lists.collect()} if lists is not None else {}
    chosen = sorted(found) if runs is None else list(runs)
    missing = [run for run in chosen if run not in found]
    if missing or not chosen:
        raise ValueError(f"no committed run {missing or ''} at {path}")
    parts = []
    for run in chosen:
        schema = StructType.fromJson(json.loads(found[run]["schema"]))
        rows = spark.read.schema(schema).parquet(f"{path}/{found[run]['folder']}").select(*schema.names)
        parts.append(rows.withColumn("run", F.lit(run)))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def submission(
    scored: DataFrame, id_col: str = "id", score: str = "score", label: str = "label", offset: int = 30000
) -> DataFrame:
    """``(id + offset, label = score)`` per scored row."""
    return scored.select(
        (F.col(id_col) + F.lit(offset)).alias(id_col), F.col(score).cast("double").alias(label)
    )


def submission_check(
    submitted: DataFrame, sample: DataFrame, id_col: str = "id", position: str | None = None
) -> DataFrame:
    """Ids whose number of occurrences differs (or, with ``position``, whose place differs).

    An empty result means that the submission matches the sample.
    """
    if len(submitted.columns) != len(sample.columns):
        raise ValueError(f"expected {len(sample.columns)} columns, got {len(submitted.columns)}")
    keys = [id_col, position] if position else [id_col]
    ours = submitted.groupBy(*keys).agg(F.count(F.lit(1)).alias("submitted_rows"))
    theirs = sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_rows"))
    both = ours.join(theirs, keys, "full_outer").na.fill(0, ["submitted_rows", "sample_rows"])
    return both.filter(F.col("submitted_rows") != F.col("sample_rows"))


def eval_predictions(
    scored: DataFrame, raw: DataFrame, id_col: str = "id", label: str = "label", score: str = "score"
) -> DataFrame:
    """``id, label, y_pred`` of the raw rows that were scored."""
    preds = scored.select(id_col, F.col(score).alias("y_pred"))
    return raw.select(id_col, label).join(preds, id_col)


def append_params(spark: SparkSession, path: str, run: str, params: Mapping, metric: float) -> bool:
    """Append one row per parameter of a tuning result to a parquet table; True if this call added them.

    A run that the table already holds adds nothing, so a job can be repeated.  All rows of a run lie in one
    file, which a failed attempt leaves out altogether.
    """
    files, to_path = _files(spark, path)
    schema = "run string, param string, value string, metric double"
    if files.exists(to_path(path)) and not spark.read.schema(schema).parquet(path).filter(F.col("run") == run).isEmpty():
        return False
    rows = [(run, k, json.dumps(v), float(metric)) for k, v in params.items()]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return True
