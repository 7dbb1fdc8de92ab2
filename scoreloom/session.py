"""Spark session and materialisation helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "scoreloom", cores: int | None = None) -> SparkSession:
    """A session with the settings the library is tuned for.

    On a cluster the submitted configuration wins: only values that are unset are filled in,
    and the master is chosen here only when ``cores`` is given.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording the Python call site of every expression is costly on wide frames.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if home not in os.environ.get("PYTHONPATH", "").split(os.pathsep):  # Python workers of a local session inherit it
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (home, os.environ.get("PYTHONPATH"))))
    if cores:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
            .config("spark.ui.enabled", "false")
        )
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; a local one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="scoreloom-"))
    else:
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that every executor can reach; "
            "fitted state is written there"
        )


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path beside the checkpoints, in the folder that every executor reaches."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """Write a wide intermediate frame once, as parquet beside the checkpoints, and read it back.

    Later passes then read only the columns they need instead of recomputing the frame.
    """
    path = shared_path(df.sparkSession, "frame")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """:func:`store` for the length of a fit whose result no longer reads the frame; its files are deleted afterwards."""
    spark = df.sparkSession
    path = shared_path(spark, "frame")
    try:
        df.write.parquet(path)
        yield spark.read.parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def store_computed(df: DataFrame) -> DataFrame:
    """:func:`store` a frame that is joined, grouped or otherwise computed; one that only reads stays as it is."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    return df if node.children().isEmpty() else store(df)


@contextmanager
def cached(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a frame that is read many times; a cache the caller made is left alone."""
    if df.is_cached:
        yield df
        return
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is configured for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
