"""Exact nearest neighbours among distinct points.

Space is cut into cells by a tree: the root from a bounded sample on the driver, every node that still
holds too many points -- by its true count -- from a sample of its own in a task.  Every cell is searched on
its own first; that bounds the distance of the k-th neighbour.  A point then goes down the tree, one level per
shuffle, only into the nodes whose bounding box its ball touches, and is compared with the points of the
leaves it reaches.  No pair of rows is ever written out: a task returns at most k neighbours per point it
was asked about, and no list of all cells reaches the driver or a task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .lookup import attach
from .ordering import row_hash

SAMPLE_POINTS = 20_000
# Children of a node, points of a cell (a node with more than twice as many is cut again), rows of a task's group.
FANOUT = 1_000
MIN_CELL_POINTS = 2_000
ROOM = 20_000
BLOCK = 1_000
ROOT = "0"
POINTS = "key string, x array<double>, w bigint, cell string"
ASKS = "key string, x array<double>, home string, r double"


def build_cells(sample: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners of about ``cells`` boxes that tile all of space."""
    d = sample.shape[1]
    done, todo = [], [(sample, np.full(d, -math.inf), np.full(d, math.inf), cells)]
    while todo:
        points, low, high, share = todo.pop()
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(d)
        axis = int(spread.argmax())
        if share <= 1 or len(points) < 4 or not spread[axis] > 0:
            done.append((low, high))
            continue
        cut = float(np.median(points[:, axis]))
        if cut <= points[:, axis].min():
            cut = float(np.unique(points[:, axis])[1])
        left = points[:, axis] < cut
        left_high, right_low = high.copy(), low.copy()
        left_high[axis] = right_low[axis] = cut
        todo.append((points[left], low, left_high, share / 2))
        todo.append((points[~left], right_low, high, share / 2))
    return np.array([b[0] for b in done]), np.array([b[1] for b in done])


def _owner(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    owner = np.empty(len(x), dtype=np.int64)
    for start in range(0, len(x), BLOCK):
        block = x[start : start + BLOCK, None, :]
        owner[start : start + BLOCK] = ((block >= low) & (block < high)).all(axis=2).argmax(axis=1)
    return owner


def _nearest(queries: np.ndarray, points: np.ndarray, k: int, own: np.ndarray | None):
    """Indices and distances of the k nearest points; ``own`` marks each query's own index."""
    k = min(k, len(points) - (own is not None))
    index = np.zeros((len(queries), max(k, 0)), dtype=np.int64)
    dist = np.zeros((len(queries), max(k, 0)))
    if k <= 0:
        return index, dist
    for start in range(0, len(queries), BLOCK):
        block = queries[start : start + BLOCK]
        square = np.zeros((len(block), len(points)))
        for axis in range(points.shape[1]):
            square += (block[:, axis, None] - points[None, :, axis]) ** 2
        if own is not None:
            square[np.arange(len(block)), own[start : start + BLOCK]] = math.inf
        top = np.argpartition(square, k - 1, axis=1)[:, :k]
        index[start : start + BLOCK] = top
        dist[start : start + BLOCK] = np.sqrt(np.take_along_axis(square, top, axis=1))
    return index, dist


def _gap(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance of every point to the nearest place of every box."""
    square = np.zeros((len(x), len(low)))
    for axis in range(x.shape[1]):
        at = x[:, axis, None]
        square += np.maximum(np.maximum(low[:, axis] - at, at - high[:, axis]), 0.0) ** 2
    return np.sqrt(square)


def _ball_holding(x: np.ndarray, home: np.ndarray, cells: np.ndarray, low, high, n, k: int) -> np.ndarray:
    """Per point a radius within which the boxes beside it hold at least ``k`` other points."""
    square = np.zeros((len(x), len(low)))
    for axis in range(x.shape[1]):
        at = x[:, axis, None]
        square += np.maximum(np.abs(low[:, axis] - at), np.abs(high[:, axis] - at)) ** 2
    others = n[None, :] - (home[:, None] == cells[None, :])
    order = square.argsort(axis=1)
    enough = np.take_along_axis(others, order, axis=1).cumsum(axis=1) >= k
    far = np.sqrt(np.take_along_axis(square, order, axis=1))
    return np.where(enough.any(axis=1), far[np.arange(len(x)), enough.argmax(axis=1)], math.inf)


def _touched(asks: pd.DataFrame, cells: np.ndarray, inner: np.ndarray, low: np.ndarray, high: np.ndarray):
    """The asking rows once per box that their ball reaches, but for the cell they live in."""
    # Rounding must not hide a box that a ball just touches.
    x, r = np.stack(asks["x"].to_numpy()), asks["r"].to_numpy() * (1 + 1e-9)
    home = asks["home"].to_numpy()
    for start in range(0, len(x), BLOCK):
        part = slice(start, start + BLOCK)
        reached = (_gap(x[part], low, high) <= r[part, None]) & (home[part, None] != cells[None, :])
        which, box = np.nonzero(reached)
        yield asks.iloc[start + which][["key", "x", "home", "r"]].assign(cell=cells[box], inner=inner[box])


def _meet(asks: DataFrame, rows: DataFrame, work, schema: str) -> DataFrame:
    """``work(asks, rows)`` of every ``cell``; a cell asked about by many is cut into slices, its rows repeated in each.

    ``asks`` should be materialised: it is read twice.  A cell of ``rows`` has a bounded size.
    """
    slices = F.ceil(F.count(F.lit(1)) / F.lit(ROOM)).cast("int")
    load = materialize(asks.groupBy("cell").agg(slices.alias("slices")))
    left = attach(asks, load, ["cell"]).withColumn("slice", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int"))
    right = rows.join(load, "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    by = ["cell", "slice"]
    return left.drop("slices").groupBy(*by).cogroup(right.drop("slices").groupBy(*by)).applyInPandas(work, schema)


def _some(total, key: str, seed: int):
    """About SAMPLE_POINTS of ``total`` rows (all, if fewer), drawn by hash."""
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE_POINTS)) / total)
    return F.conv(F.substring(row_hash(key, seed), 1, 8), 16, 10).cast("double") < share * 2**32


def _cells_of(placed: DataFrame, d: int, before: DataFrame | None, total: int) -> DataFrame:
    """``parent, cell, low, high, n, inner`` of newly filled cells: tight boxes, true counts, whether to cut again.

    A node that its cut left whole is a leaf whatever its size.
    """
    table = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.min(F.col("x")[i]) for i in range(d)]).alias("low"),
        F.array(*[F.max(F.col("x")[i]) for i in range(d)]).alias("high"),
    )
    table = table.withColumn("parent", F.regexp_replace("cell", r"\.[0-9]+$", ""))
    if before is None:
        table = table.withColumn("above", F.lit(total))
    else:
        table = table.join(before.select(F.col("cell").alias("parent"), F.col("n").alias("above")), "parent")
    inner = (F.col("n") > 2 * MIN_CELL_POINTS) & (F.col("n") < F.col("above"))
    return materialize(table.select("parent", "cell", "low", "high", "n", inner.alias("inner")))


def _grow(base: DataFrame, d: int, total: int, seed: int) -> tuple[DataFrame, list[DataFrame]]:
    """The points with their leaf cell, and the nodes of every level below the root."""
    sample = np.array([r["x"] for r in base.filter(_some(F.lit(total), "key", seed)).collect()], dtype=float)
    low, high = build_cells(sample.reshape(-1, d), min(FANOUT, max(1, total // MIN_CELL_POINTS)))

    def assign(batches):
        for batch in batches:
            if len(batch):
                own = _owner(np.stack(batch["x"].to_numpy()), low, high)
                yield batch.assign(cell=[f"{ROOT}.{j}" for j in own])

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        boxes = min(fanout, int(group["n"].iloc[0]) // cell_points)
        lows, highs = build_cells(np.stack(group["x"].to_numpy()), boxes)
        return pd.DataFrame({"cell": group["cell"].iloc[0], "low": list(lows), "high": list(highs)})

    def place(points: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(len(points), dtype=np.int64)
        if len(boxes):
            own = _owner(np.stack(points["x"].to_numpy()), np.stack(boxes["low"].to_numpy()), np.stack(boxes["high"].to_numpy()))
        return points[["key", "x", "w"]].assign(cell=[f"{c}.{j}" for c, j in zip(points["cell"], own)])

    fanout, cell_points = FANOUT, MIN_CELL_POINTS
    placed = materialize(base.mapInPandas(assign, POINTS))
    leaves, levels = [], [_cells_of(placed, d, None, total)]
    while not levels[-1].filter("inner").isEmpty():
        placed = attach(placed, levels[-1].select("cell", "n", "inner"), ["cell"])
        leaves.append(placed.filter(~F.col("inner")).drop("n", "inner"))
        crowded = materialize(placed.filter("inner").drop("inner"))
        drawn = crowded.filter(_some(F.col("n"), "key", seed + len(levels))).select("cell", "x", "n")
        cuts = materialize(drawn.groupBy("cell").applyInPandas(cut, "cell string, low array<double>, high array<double>"))
        placed = materialize(_meet(crowded.drop("n"), cuts, place, POINTS))
        levels.append(_cells_of(placed, d, levels[-1], total))
    for part in leaves:
        placed = placed.unionByName(part)
    return placed, levels


def nearest_neighbors(
    points: DataFrame, columns: Sequence[str], key: str, weight: str, k: int, seed: int = 0
) -> DataFrame:
    """``key, neighbor array<double>, times, distance``: the k nearest other points of every point.

    ``points`` holds distinct, complete points; ``key`` is a unique text and ``weight`` a number
    handed back as the neighbour's ``times``.  Equally distant neighbours are taken in the order of their values.
    """
    d = len(columns)
    total = points.count()
    base = points.select(
        F.col(key).alias("key"),
        F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("x"),
        F.col(weight).cast("long").alias("w"),
    )
    placed, levels = _grow(base, d, total, seed)
    found = "key string, neighbor array<double>, times bigint, distance double"

    def rows(keys, index, dist, x, weights):
        return pd.DataFrame(
            {
                "key": np.repeat(keys, index.shape[1]),
                "neighbor": pd.Series([x[j] for j in index.ravel()], dtype=object),
                "times": weights[index.ravel()],
                "distance": dist.ravel(),
            }
        )

    def search_own(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["x"].to_numpy())
        index, dist = _nearest(x, x, k, np.arange(len(x)))
        return rows(group["key"].to_numpy(), index, dist, x, group["w"].to_numpy())

    own = placed.groupBy("cell").applyInPandas(search_own, found)
    top = levels[0].collect()  # at most FANOUT children of the root
    if len(top) <= 1:
        return own
    own = materialize(own)

    # The ball of a point: up to its k-th neighbour at home; where home holds too few, up to boxes beside it that hold enough.
    reach = own.groupBy("key").agg(F.max("distance").alias("r"), F.count(F.lit(1)).alias("n"))
    asking = materialize(
        placed.join(reach, "key", "left").select("key", "x", F.col("cell").alias("home"), F.when(F.col("n") >= k, F.col("r")).alias("r"))
    )
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    below = nodes.select(F.col("parent").alias("cell"), F.col("cell").alias("child"), "low", "high", "n", "inner")

    def boxes_of(table: pd.DataFrame):
        return np.stack(table["low"].to_numpy()), np.stack(table["high"].to_numpy())

    def widen(asks: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        x, home, cells = np.stack(asks["x"].to_numpy()), asks["home"].to_numpy(), boxes["child"].to_numpy()
        corners, n = boxes_of(boxes), boxes["n"].to_numpy()
        r = [_ball_holding(x[s : s + BLOCK], home[s : s + BLOCK], cells, *corners, n, k) for s in range(0, len(x), BLOCK)]
        return asks[["key", "x", "home"]].assign(r=np.concatenate(r))

    few = asking.filter(F.col("r").isNull()).withColumn("cell", F.regexp_replace("home", r"\.[0-9]+$", ""))
    asking = asking.filter(F.col("r").isNotNull()).unionByName(_meet(few, below, widen, ASKS))

    low, high = (np.array([r[side] for r in top], dtype=float) for side in ("low", "high"))
    cells, inner = np.array([r["cell"] for r in top], dtype=object), np.array([r["inner"] for r in top])
    reached = ASKS + ", cell string, inner boolean"

    def enter(batches):
        for batch in batches:
            if len(batch):
                yield from _touched(batch, cells, inner, low, high)

    def descend(asks: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(_touched(asks, boxes["child"].to_numpy(), boxes["inner"].to_numpy(), *boxes_of(boxes)))

    step = materialize(asking.mapInPandas(enter, reached))
    visits = step.filter(~F.col("inner"))
    for _ in levels[1:]:
        step = materialize(_meet(step.filter("inner").drop("inner"), below, descend, reached))
        visits = visits.unionByName(step.filter(~F.col("inner")))

    def search_other(queries: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(here["x"].to_numpy())
        index, dist = _nearest(np.stack(queries["x"].to_numpy()), x, k, None)
        return rows(queries["key"].to_numpy(), index, dist, x, here["w"].to_numpy())

    other = _meet(visits.select("key", "x", "cell"), placed, search_other, found)
    order = Window.partitionBy("key").orderBy("distance", "neighbor")
    return (
        own.unionByName(other)
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= k)
        .drop("_rank")
    )
