"""Exact k-means over integer vectors with a vantage-point tree over the centroids.

A round builds a tree over the centroids on the driver (their number is a parameter), broadcasts it and looks every
vector up in it.  A vector visits nodes best first: of all nodes it has not entered, the one whose bound on the distance
is smallest.  It stops when that bound lies beyond its best distance; a node at exactly that distance is still
entered, since it may hold an equally near centroid with a smaller number.  Bounds are floating-point numbers with a
slack above their rounding error, distances in nodes are exact 64-bit integers, so the result equals a full search.

All vectors of a batch take their steps together: those that enter the same node are measured against it at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.session import store

from .common import to_arrow

#: Components stay below this, so that a squared distance of 64 of them fits in 64 bits.
LARGEST = 1 << 27
SLACK = 1e-9
LEAF = 6
BATCH = 4096


class _Node:
    """A vantage point with two children split at the median distance, or a leaf of some centroids.

    ``ranges`` holds, per child, the smallest and largest distance from the vantage point to the child's centroids.
    """

    __slots__ = ("points", "children", "ranges")

    def __init__(self, points: list[int], children: list[int], ranges: list[tuple[float, float]]):
        self.points, self.children, self.ranges = points, children, ranges


class VantageTree:
    """Nearest of a few centroids, the smallest number on ties."""

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF):
        self.centroids, self.nodes = centroids, []
        if len(centroids):
            self._build(list(range(len(centroids))), leaf)

    def _build(self, points: list[int], leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append(_Node(points, [], []))
        if len(points) <= leaf:
            return at
        vantage = self._vantage(points)
        rest = [i for i in points if i != vantage]
        squares = squared(self.centroids[rest], self.centroids[vantage][None])[:, 0]
        order = sorted(range(len(rest)), key=lambda j: (squares[j], rest[j]))
        node, half = self.nodes[at], len(rest) // 2
        node.points = [vantage]
        for part in filter(None, (order[:half], order[half:])):
            reach = np.sqrt(squares[part].astype(float))
            node.ranges.append((float(reach.min()), float(reach.max())))
            node.children.append(self._build(sorted(rest[j] for j in part), leaf))
        return at

    def _vantage(self, points: list[int]) -> int:
        """The point whose distances to the others are spread most."""
        every = self.centroids[points]
        reach = np.sqrt(squared(every, every).astype(float))
        spread = reach.var(axis=1)
        return points[int(np.argmax(spread))]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid number and exact squared distance of every vector."""
        n = len(vectors)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.centroids))
        bounds = np.full((n, len(self.nodes)), np.inf)  # of nodes that wait to be entered
        bounds[:, 0] = 0
        active = np.arange(n)
        while len(active):
            node = bounds[active].argmin(axis=1)
            bound = bounds[active, node]
            reach = np.sqrt(best[active].astype(float))
            go = (bound < np.inf) & (bound <= reach * (1 + SLACK) + SLACK)  # inclusive: ties may be inside
            active, node, bound = active[go], node[go], bound[go]
            for k in np.unique(node):
                here = node == k
                self._enter(int(k), active[here], bound[here], vectors, best, number, bounds)
        return number, best

    def _enter(self, k: int, rows: np.ndarray, bound: np.ndarray, vectors: np.ndarray, best: np.ndarray, number: np.ndarray, bounds: np.ndarray) -> None:
        """Measure vectors against a node's centroids and let its children wait."""
        node = self.nodes[k]
        bounds[rows, k] = np.inf
        squares = squared(vectors[rows], self.centroids[node.points])
        first = squares.argmin(axis=1)  # points are in ascending order
        least, which = squares[np.arange(len(rows)), first], np.array(node.points)[first]
        better = (least < best[rows]) | (least == best[rows]) & (which < number[rows])
        best[rows[better]], number[rows[better]] = least[better], which[better]
        if node.children:
            away = np.sqrt(squares[:, 0].astype(float))
            for child, (low, high) in zip(node.children, node.ranges):
                gap = np.maximum(away - high, low - away) - SLACK * (away + high)
                bounds[rows, child] = np.maximum(bound, gap)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors, rows of ``a`` by rows of ``b``."""
    out = np.empty((len(a), len(b)), np.int64)
    for j, point in enumerate(b):
        gap = a - point
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


def whole_vectors(table: DataFrame, size: int = 64, scale: int = 256) -> DataFrame:
    """``vec_id, vector`` of the rows whose embedding has ``size`` components, none null or non-finite.

    A component x becomes ``floor(scale * x)``; one of 2^27 or more in size raises, as distances would not fit.
    """
    x = F.col("embedding").cast("array<double>")
    whole = F.transform(x, lambda v: F.floor(v * scale))
    kept = table.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(
        (F.size("embedding") == size)
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    )
    large = F.exists("embedding", lambda v: F.abs(v) >= LARGEST / scale)
    checked = F.when(large, F.raise_error(F.lit(f"a component exceeds {LARGEST // scale}")).cast("array<int>")).otherwise(whole.cast("array<int>"))
    return kept.select("vec_id", checked.alias("vector"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def _mapped(vectors: DataFrame, centroids: np.ndarray, ddl: str, start: Callable, each: Callable, end: Callable) -> DataFrame:
    """Look all vectors up in a broadcast tree: ``each(state, ids, whole, number, square)`` gives columns or None per batch."""
    schema = to_arrow(vectors.sparkSession, ddl)
    tree = vectors.sparkSession.sparkContext.broadcast(VantageTree(centroids))
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                whole = _matrix(part.column(1), size)
                number, square = tree.value.nearest(whole)
                if (columns := each(state, part.column(0), whole, number, square)) is not None:
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
        if (columns := end(state)) is not None:
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return vectors.select("vec_id", "vector").mapInArrow(run, ddl)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Per non-empty cluster its count and exact component sums; a task sends one row per cluster."""
    k, size = centroids.shape

    def start() -> tuple[np.ndarray, list]:
        return np.zeros(k, np.int64), [[0] * size for _ in range(k)]

    def each(state, ids, whole, number, square) -> None:
        counts, sums = state
        counts += np.bincount(number, minlength=k)
        for c in np.unique(number):  # a batch's sums fit in 64 bits, a task's are Python integers
            sums[c] = [a + b for a, b in zip(sums[c], whole[number == c].sum(axis=0).tolist())]

    def end(state) -> list[pa.Array]:
        counts, sums = state
        used = np.flatnonzero(counts)
        return [pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array([list(map(str, sums[c])) for c in used], pa.list_(pa.string()))]

    partial = _mapped(vectors, centroids, "cluster int, n long, sums array<string>", start, each, end)
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    rows = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect()  # one row per cluster
    return {r.cluster: (r.n, [int(r[f"s{i}"]) for i in range(size)]) for r in rows}


def first_centroids(vectors: DataFrame, clusters: int, seed: int, size: int) -> np.ndarray:
    """The vectors whose ``seed:vec_id`` has the smallest sha256; null ids come last, repeated ids by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "vector").limit(clusters).select("vector").collect()
    return np.array([r.vector for r in rows], np.int64).reshape(len(rows), size)


def cluster_vectors(table: DataFrame, clusters: int = 40, rounds: int = 5, seed: int = 2, size: int = 64, scale: int = 256) -> DataFrame:
    """Per kept vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors with another number of components, a null or a non-finite one are left out.  Ties go to the smaller cluster number, a
    cluster that loses all vectors keeps its centroid, repeated rows count each, a null ``vec_id`` is assigned but never
    starts a cluster while there are others.  With fewer vectors than clusters each starts one; without any the
    result is empty.  Extra columns are ignored.
    """
    spark = table.sparkSession
    ddl = "vec_id long, cluster int, distance long"
    vectors = store(whole_vectors(table, size, scale))
    centroids = first_centroids(vectors, clusters, seed, size)
    for _ in range(rounds if len(centroids) else 0):
        for c, (n, sums) in _sums(vectors, centroids).items():
            centroids[c] = [s // n for s in sums]  # Python's division of integers rounds down

    def each(_, ids, whole, number, square) -> list[pa.Array]:
        return [ids, pa.array(number.astype(np.int32)), pa.array(square)]

    if not len(centroids):
        empty = spark.createDataFrame([], ddl)
        return empty.select("*", *[F.lit(0).cast("long").alias(c) for c in ("cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    found = store(_mapped(vectors, centroids, ddl, lambda: None, each, lambda _: None))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("s")).collect()
    inertia = {r.cluster: r.s for r in sums}
    rows = [
        (c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c in sorted(inertia)
    ]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _cluster_sql(clusters: int = 40, rounds: int = 5, seed: int = 2, size: int = 64, scale: int = 256) -> str:
    gap = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.x, c.x)])::BIGINT"
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"d{r} AS MATERIALIZED (SELECT v.vec_id, v.x, c.c, {gap} AS d FROM v, c{r} c), "
            f"a{r} AS MATERIALIZED (SELECT vec_id, x, c, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS k FROM d{r}) WHERE k = 1)"
        )
        if r < rounds:
            steps.append(
                f"m{r} AS MATERIALIZED (SELECT c, list(f ORDER BY i) AS x FROM (SELECT c, i, floor(sum(x[i])::DECIMAL(38, 0) / count(*))::BIGINT AS f "
                f"FROM a{r}, (SELECT unnest(range(1, {size + 1})) AS i) GROUP BY c, i) GROUP BY c), "
                f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (c))"
            )
    return f"""
WITH v AS MATERIALIZED (
    SELECT vec_id, [floor({scale} * e::DOUBLE)::BIGINT for e in embedding] AS x FROM embeddings
    WHERE len(embedding) = {size} AND len([e for e in embedding if e IS NOT NULL AND isfinite(e)]) = {size}
), c0 AS MATERIALIZED (
    SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1)::INTEGER AS c, x FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {clusters}
), {", ".join(steps)}
SELECT vec_id, c AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
    sha256(array_to_string((SELECT x FROM c{rounds} f WHERE f.c = a{rounds}.c), ',')) AS centroid_sha256
FROM a{rounds}
"""


CLUSTER_SQL = _cluster_sql()
