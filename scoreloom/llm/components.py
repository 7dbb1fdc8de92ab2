"""Connected components of a link table: alternating stars, or one task where the table is measured to be small."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.session import store

#: Links, after duplicates have gone, up to which one task joins them all; it then holds some 50 MB at most.
AT_ONCE = 200_000


def _settled(edges: DataFrame) -> bool:
    """Whether every edge already runs from a node of its own to a root that starts no edge."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.union(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.where("out > 1 or out = 1 and into = 1").isEmpty()


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them (edges run from larger to smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _in_one_task(edges: DataFrame) -> DataFrame:
    """The components by union-find."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}
        arrow = None

        def root(x):
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for batch in batches:
            arrow = batch.schema.field(0).type
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                above.setdefault(a, a)
                above.setdefault(b, b)
                a, b = root(a), root(b)
                if a != b:
                    above[max(a, b)] = min(a, b)
        nodes = list(above)
        for at in range(0, len(nodes), 10_000):
            part = nodes[at : at + 10_000]
            columns = [pa.array(part, arrow), pa.array([root(x) for x in part], arrow)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def connected_components(links: DataFrame, rounds: int = 60, at_once: int = AT_ONCE) -> DataFrame:
    """``(node, component)`` of every node that a link (columns ``a``, ``b``, comparable values) names.

    The component is its smallest node.  The distinct links are written and counted.  Up to ``at_once`` of them are
    joined in one task.  Beyond that each round of stars at least halves paths and is written to the shared folder, so a
    lost executor costs one round at most.  Both ways give the same rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = store(edges)
    if edges.count() <= at_once:
        return store(_in_one_task(edges))
    for _ in range(rounds):
        if _settled(edges):
            break
        edges = store(_small(store(_large(edges))))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return store(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots))
