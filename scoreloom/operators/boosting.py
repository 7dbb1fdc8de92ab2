"""Boosted trees on binned columns with gaps, many models in one pass.

A model's next tree grows level by level: every task adds up, per open node, column and bin, the gradients, curvatures and rows of
its part of the data, and these histograms are summed on their way to the driver.  Rows never move.  NULL and NaN have a bin of
their own; each cut is tried with the missing rows on either side, and the better side is what the tree remembers.

Models that differ in columns, settings or left-out folds grow side by side: a pass over the rows serves all of them.  The rows
are kept as small blocks of bin numbers; scores of finished trees are folded into the blocks every few trees, later
trees are replayed, so a lost block is made again from the frame and the trees.

When all blocks together are small (``BROADCAST_BYTES``, measured), passes would spend their time on starting tasks.  The blocks
are then broadcast and every model grows in a task of its own, by the same steps.

A tree cannot tell rows apart whose bins are equal.  When the blocks are not small, rows of equal bins are therefore counted first, in one
shuffle: a cell holds, for the training rows of every model and each label, how many rows it stands for, however many folds (and folds
of folds) they come from.  All passes then run over the cells.  Models that sample rows keep the rows themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 16_384
TASK_CELLS = 400_000
PASS_CELLS = 4_000_000
BROADCAST_BYTES = 16 << 20
#: Counted cells with the numbers of all models may be so many times larger, since a task goes over those of its own model only.
CELLS_FACTOR = 4
#: Rows counted at once, bytes of counts that a task keeps, and histogram cells whose cuts are tried at once.
COUNT_ROWS, COUNT_BYTES, CHOICE_CELLS = 1 << 17, 64 << 20, 400_000
KEEP = 16
SCALES = [2.0**k for k in range(-8, 9)]
LEAST_GAIN = 1e-12


@dataclass(frozen=True)
class Settings:
    """How the trees of one model grow; ``natural`` takes least-squares steps along the Bernoulli natural gradient."""

    trees: int = 100
    depth: int = 5
    rate: float = 0.1
    penalty: float = 0.0
    min_rows: int = 1
    rows_share: float = 1.0
    tree_columns: float = 1.0
    level_columns: float = 1.0
    bins: int = 255
    natural: bool = False
    patience: int = 50
    seed: int = 0
    weights: tuple[float, float] = (1.0, 1.0)


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has feature -1.  ``cut``: largest value that goes left, ``bin``: its bin."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: int = 0

    def split(self, node: int, feature: int, cut: float, bin_: int, missing_left: bool, values: tuple[float, float]) -> tuple[int, int]:
        """Make a leaf an inner node; the numbers of its children."""
        left = len(self.feature)
        self.feature[node], self.cut[node], self.bin[node], self.missing_left[node] = feature, cut, bin_, missing_left
        self.left[node], self.right[node] = left, left + 1
        for i, value in enumerate(values):
            self.feature.append(-1)
            self.cut.append(0.0)
            self.bin.append(0)
            self.missing_left.append(True)
            self.left.append(left + i)
            self.right.append(left + i)
            self.value.append(value)
        return left, left + 1

    def leaves(self, x: np.ndarray, missing: np.ndarray | None = None, known: tuple[np.ndarray, int] | None = None) -> np.ndarray:
        """The leaf of every row of bins (``missing``: each column's bin of gaps) or of values; ``known``: their nodes at some depth."""
        at, done = known or (np.zeros(len(x), np.int64), 0)
        if done >= self.depth:
            return at
        feature, left, right, gap_left = (np.array(v) for v in (self.feature, self.left, self.right, self.missing_left))
        cut, rows = np.array(self.cut if missing is None else self.bin), np.arange(len(x))
        for _ in range(done, self.depth):
            f = feature[at]
            v = x[rows, np.maximum(f, 0)]
            gap = np.isnan(v) if missing is None else v == missing[f]
            at = np.where(f < 0, at, np.where(np.where(gap, gap_left[at], v <= cut[at]), left[at], right[at]))
        return at

    def add(self, x: np.ndarray, missing: np.ndarray | None = None) -> np.ndarray:
        return np.array(self.value)[self.leaves(x, missing)]


@dataclass
class Boosted:
    """A fitted model: score of no tree, trees, and the gain of every column."""

    start: float
    trees: list[Tree]
    gains: list[float]
    losses: list[tuple[float, float]] = field(default_factory=list)

    def margins(self, x: np.ndarray, steps: Sequence[int]) -> Iterator[np.ndarray]:
        """Log odds after each of some ascending numbers of trees."""
        total, done = np.full(len(x), self.start), 0
        for step in steps:
            for tree in self.trees[done:step]:
                total = total + tree.add(x)
            done = max(done, step)
            yield total

    def info(self) -> dict:
        return {"start": self.start, "gains": self.gains, "trees": [vars(t) for t in self.trees]}

    @classmethod
    def of(cls, info: dict) -> Boosted:
        return cls(info["start"], [Tree(**t) for t in info["trees"]], info["gains"])


@dataclass
class Plan:
    """One model to grow: positions of its columns in the frame, settings, and the fold it must not see.

    With several fold columns ``fold`` has a number for each of them, None where it may see all.  ``part`` is the place of its
    training rows in the numbers of counted cells.
    """

    columns: list[int]
    settings: Settings
    fold: int | tuple | None = None
    part: int = 0

    def without(self) -> tuple[tuple[int, int], ...]:
        """Fold columns and the values whose rows are not learned from."""
        folds = self.fold if isinstance(self.fold, tuple) else (self.fold,)
        return tuple((i, k) for i, k in enumerate(folds) if k is not None)


def few_values(df: DataFrame, columns: Sequence[str], bins: int) -> dict[int, list[float]]:
    """The distinct finite values of the columns that have at most ``bins``; other columns are listed with None.

    A task reports at most ``bins`` + 1 distinct values of a column.
    """
    numbers = df.select(*columns)

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[np.ndarray] = [np.empty(0)] * len(columns)
        for batch in batches:
            for i, c in enumerate(columns):
                if len(found[i]) <= bins:
                    x = batch[c].to_numpy(float)
                    found[i] = np.unique(np.append(found[i], x[np.isfinite(x)]))[: bins + 1]
        yield pd.DataFrame({"i": np.repeat(np.arange(len(columns)), [len(f) for f in found]), "v": np.concatenate(found) if found else []})

    values = numbers.mapInPandas(distinct, "i int, v double").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = {r.i: r.n for r in values.groupBy("i").agg(F.count("*").alias("n")).collect()}
        few = sorted(i for i, n in counts.items() if n <= bins)
        listed: dict = {i: [] if i in few else None for i in counts}
        for r in values.filter(F.col("i").isin(few)).collect() if few else []:  # at most ``bins`` per column
            listed[r.i].append(r.v)
    finally:
        values.unpersist()
    return listed


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int, listed: dict | None = None) -> list[np.ndarray]:
    """Ascending upper edges per column: all distinct values if they are at most ``bins``, else about ``bins`` quantiles.

    The quantiles are Spark's mergeable sketches.  ``listed`` is what :func:`few_values` found for as many bins or more.
    """
    listed = few_values(df, columns, bins) if listed is None else listed
    edges = [np.empty(0)] * len(columns)
    many = sorted(i for i, v in listed.items() if v is None or len(v) > bins)
    for i, v in listed.items():
        if i not in many:
            edges[i] = np.array(sorted(v))
    if many:
        numbers = df.select(*columns)
        shares = [k / bins for k in range(1, bins)] + [1.0]
        clean = numbers.select(*[F.when(~F.isnan(columns[i]) & (F.abs(columns[i]) < float("inf")), F.col(columns[i])).alias(columns[i]) for i in many])
        for i, q in zip(many, clean.approxQuantile([columns[i] for i in many], shares, 0.25 / bins)):
            edges[i] = np.unique(q)
    return edges


def _bin_type(edges: list[np.ndarray]) -> type:
    return np.uint8 if max(map(len, edges), default=0) < 255 else np.uint16


def _bins(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin numbers of one column; NaN has the bin behind the last."""
    return np.where(np.isnan(values), len(edges), np.minimum(np.searchsorted(edges, values), max(0, len(edges) - 1)))


def _training_rows(df: DataFrame, columns: Sequence[str], label: str, folds: Sequence[str], valid: str | None) -> DataFrame:
    """``c0, c1, ..., y, fold0, fold1, ..., valid`` without NULL in the last ones."""
    return df.select(
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(label).cast("double").alias("y"),
        *[F.col(f"`{c}`").cast("int").alias(f"fold{i}") for i, c in enumerate(folds)],
        (F.coalesce(F.col(valid).cast("boolean"), F.lit(False)) if valid else F.lit(False)).alias("valid"),
    )


def _fold_matrix(batch: pd.DataFrame, folds: Sequence[str]) -> np.ndarray:
    return np.column_stack([np.empty((len(batch), 0), np.int32), *[batch[f"fold{i}"].to_numpy(np.int32) for i in range(len(folds))]])


def _counted(
    df: DataFrame, columns: Sequence[str], edges: list[np.ndarray], label: str, folds: Sequence[str], valid: str | None, parts: Sequence[tuple]
) -> DataFrame:
    """``cells, counts, n``: chunks of ``n`` cells of equal bins, and their numbers of rows by part and label.

    A part is what :meth:`Plan.without` leaves out of the training rows; the validation rows are a last part.
    """
    names, kind = [f"c{i}" for i in range(len(columns))], _bin_type(edges)
    wide, slots = len(columns) * np.dtype(kind).itemsize, len(parts) + 1

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.empty((len(batch), len(names)), kind)
            for i, (c, e) in enumerate(zip(names, edges)):
                x[:, i] = _bins(batch[c].to_numpy(float), e)
            marks = np.column_stack([(batch["y"].to_numpy() == 1).astype(np.int32), batch["valid"].to_numpy(bool).astype(np.int32), _fold_matrix(batch, folds)])
            yield pd.DataFrame({"cell": [r.tobytes() for r in x], "marks": [r.tobytes() for r in marks]})

    def tally(cells: list[bytes], marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), wide)
        m = np.frombuffer(b"".join(marks), np.int32).reshape(len(cells), -1)
        found, at = distinct_rows(x)
        counts, place, flagged = np.zeros((len(found), slots, 2), np.uint32), 2 * at + m[:, 0], m[:, 1] == 1
        for i, part in enumerate([*parts, None]):
            rows = flagged if part is None else ~flagged
            for c, value in part or ():
                rows = rows & (m[:, 2 + c] != value)
            counts[:, i] = np.bincount(place[rows], minlength=2 * len(found)).reshape(-1, 2)
        return found, counts

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.empty((0, wide), np.uint8), np.empty((0, slots, 2), np.uint32)
        cells: list[bytes] = []
        marks: list[bytes] = []
        for batch in batches:
            cells += list(batch["cell"])
            marks += list(batch["marks"])
            if len(cells) >= COUNT_ROWS:
                held, cells, marks = _joined(held, tally(cells, marks)), [], []
                if held[1].nbytes > COUNT_BYTES:
                    yield _chunk(*held)
                    held = held[0][:0], held[1][:0]
        if cells:
            held = _joined(held, tally(cells, marks))
        if len(held[0]):
            yield _chunk(*held)

    rows = _training_rows(df, columns, label, folds, valid).mapInPandas(code, "cell binary, marks binary")
    return rows.repartition("cell").mapInPandas(count, "cells binary, counts binary, n long")


def _chunk(cells: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"cells": [cells.tobytes()], "counts": [counts.tobytes()], "n": [len(cells)]})


def _joined(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of both, with their numbers added up."""
    if not len(a[0]):
        return b
    return _added(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))


def _added(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells and the sums of their numbers."""
    found, at = distinct_rows(cells)
    order = np.argsort(at, kind="stable")
    return found, np.add.reduceat(counts[order], np.flatnonzero(np.diff(at[order], prepend=-1)), axis=0)


def _read_chunk(r, width: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the cells of a chunk, and their numbers by part and label."""
    return np.frombuffer(r.cells, kind).reshape(r.n, width), np.frombuffer(r.counts, np.uint32).reshape(r.n, -1, 2)


def _cell_block(x: np.ndarray, counts: np.ndarray) -> dict:
    """A block of cells: a row for each label that a cell has, ``n`` the numbers by part."""
    kept = [np.flatnonzero(counts[:, :, y].any(axis=1)) for y in (0, 1)]
    return {
        "x": np.concatenate([x[k] for k in kept]), "y": np.repeat([0.0, 1.0], [len(k) for k in kept]),
        "n": np.concatenate([counts[k, :, y] for y, k in enumerate(kept)]), "score": None,
    }


def distinct_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix of bytes, and the number among them of every row."""
    if not x.size:
        return x[: min(1, len(x))], np.zeros(len(x), np.int64)
    x = np.ascontiguousarray(x)
    _, first, at = np.unique(x.view(f"V{x.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return x[first], at


def _blocks(df: DataFrame, columns: Sequence[str], edges: list[np.ndarray], label: str, folds: Sequence[str], valid: str | None, cells: int) -> RDD:
    """Blocks of bin numbers, labels, folds, validation flags and a hash of the values of each row."""
    d, kind = len(columns), _bin_type(edges)
    names = [f"c{i}" for i in range(d)]
    rows = _training_rows(df, columns, label, folds, valid)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.iloc[at : at + BLOCK_ROWS]
                values = part[names].to_numpy(float)
                x = np.empty(values.shape, kind)
                key = np.zeros(len(part), np.uint64)
                for i, e in enumerate(edges):
                    v = values[:, i]
                    x[:, i] = _bins(v, e)
                    key = (key ^ np.where(np.isnan(v), 0.5, v + 0.0).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                yield pd.DataFrame(
                    {
                        "x": [x.tobytes()], "y": [part["y"].to_numpy(np.float64).tobytes()], "fold": [_fold_matrix(part, folds).tobytes()],
                        "valid": [part["valid"].to_numpy(bool).tobytes()], "key": [key.tobytes()],
                    }
                )

    packed = rows.mapInPandas(make, "x binary, y binary, fold binary, valid binary, key binary")

    def read(r) -> dict:
        x = np.frombuffer(r.x, kind).reshape(-1, d)
        return {
            "x": x, "y": np.frombuffer(r.y, np.float64), "fold": np.frombuffer(r.fold, np.int32).reshape(len(x), -1), "valid": np.frombuffer(r.valid, bool),
            "key": np.frombuffer(r.key, np.uint64), "n": np.ones(len(x)), "score": None,
        }

    blocks = packed.rdd.map(read)
    return blocks.coalesce(min(blocks.getNumPartitions(), cells)) if cells else blocks


def _sampled(key: np.ndarray, seed: int, share: float) -> np.ndarray | bool:
    """Rows drawn for a tree, a function of their values and the seed."""
    if share >= 1:
        return True
    mixed = (key ^ np.uint64(seed * 2654435761 % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return (mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(11)).astype(float) < share * 2.0**53


class _Spread:
    """Blocks in the tasks of a cluster."""

    keep, first_scales = KEEP, SCALES

    def __init__(self, blocks: RDD):
        self.base = self.blocks = blocks

    def add(self, work, state) -> list:
        """Sum of ``work(block, state)`` over all blocks, a list of arrays; summed in tasks, then by a tree of tasks."""
        shared = self.base.context.broadcast(state)

        def part(blocks):
            total = None
            for block in blocks:
                total = _plus(total, work(block, shared.value))
            return [] if total is None else [total]

        try:
            return self.blocks.mapPartitions(part).treeReduce(_plus, depth=2)
        finally:
            shared.unpersist()

    def change(self, work, state) -> None:
        """Replace every block by ``work(block, state)``."""
        shared = self.base.context.broadcast(state)
        new = self.blocks.map(lambda block: work(block, shared.value)).persist(StorageLevel.MEMORY_AND_DISK)
        new.count()
        self.drop()
        self.blocks = new

    def drop(self) -> None:
        if self.blocks is not self.base:
            self.blocks.unpersist()


class _AtHand:
    """Blocks in the memory of one task."""

    keep, first_scales = 1, (0.5, 1.0, 2.0)

    def __init__(self, blocks: list[dict]):
        self.blocks = blocks

    def add(self, work, state) -> list:
        total = None
        for block in self.blocks:
            total = _plus(total, work(block, state))
        return total

    def change(self, work, state) -> None:
        self.blocks = [work(block, state) for block in self.blocks]

    def drop(self) -> None:
        self.blocks = []


def _plus(a: list | None, b: list) -> list:
    return b if a is None else [x + y for x, y in zip(a, b)]


class _Grower:
    """The trees of several models, grown together over one set of blocks."""

    def __init__(self, plans: list[Plan], edges: list[np.ndarray], blocks: _Spread | _AtHand):
        self.plans, self.edges, self.blocks = plans, edges, blocks
        self.missing = np.array([len(e) for e in edges])
        self.models = [Boosted(0.0, [], [0.0] * len(p.columns)) for p in plans]
        self.cells = []  # per plan: first cell of each column and their number
        for p in plans:
            sizes = np.array([len(edges[c]) + 1 for c in p.columns])
            self.cells.append((np.cumsum(sizes) - sizes, int(sizes.sum())))

    def run(self) -> list[Boosted]:
        for model, (n, pos) in zip(self.models, self.blocks.add(_tally(self.plans), None)):
            share = min(max(pos / n, 1e-6), 1 - 1e-6) if n else 0.5
            model.start = math.log(share / (1 - share))
        self._fold_in([[] for _ in self.plans])
        pending: list[list[Tree]] = [[] for _ in self.plans]
        best = [(math.inf, 0)] * len(self.plans)
        open_plans = [i for i, p in enumerate(self.plans) if p.settings.trees > 0]
        step = 0
        while open_plans:
            trees = self._tree(open_plans, pending, step, best)
            step += 1
            for i in list(open_plans):
                if trees[i] is None:
                    open_plans.remove(i)
                    continue
                self.models[i].trees.append(trees[i])
                pending[i].append(trees[i])
                if step >= self.plans[i].settings.trees:
                    open_plans.remove(i)
            if max((len(pending[i]) for i in open_plans), default=0) >= self.blocks.keep:
                self._fold_in(pending)
                pending = [[] for _ in self.plans]
        self.blocks.drop()
        for i, model in enumerate(self.models):
            if any(v == v for _, v in model.losses):  # stopped or ended: as many trees as were best on the validation rows
                model.trees = model.trees[: max(1, best[i][1])] if best[i][0] < math.inf else model.trees
        return self.models

    def _fold_in(self, pending: list[list[Tree]]) -> None:
        """Blocks that hold the scores of all trees so far."""
        self.blocks.change(_scored(self.plans, self.missing, [m.start for m in self.models]), pending)

    # ------------------------------------------------------------ one tree of every open plan

    def _tree(self, open_plans: list[int], pending: list[list[Tree]], step: int, best: list) -> dict[int, Tree | None]:
        trees: dict[int, Tree | None] = {i: Tree() for i in open_plans}
        draws = {i: np.random.default_rng([self.plans[i].settings.seed, step]) for i in open_plans}
        allowed = {i: self._draw(draws[i], np.arange(len(self.plans[i].columns)), self.plans[i].settings.tree_columns) for i in open_plans}
        frontier = {i: [0] for i in open_plans}
        level = 0
        while frontier:
            splits: dict[int, list] = {i: [] for i in frontier}
            for turn in self._turns(frontier):
                state = (step, level, {i: (pending[i], trees[i], nodes) for i, nodes in turn.items()})
                found = self.blocks.add(_histograms(self.plans, self.cells, self.missing), state)
                for (i, nodes), hist, loss in zip(turn.items(), found[::2], found[1::2]):
                    if level == 0 and not self._go_on(i, loss, step, best):
                        trees[i] = None
                        continue
                    columns = self._draw(draws[i], allowed[i], self.plans[i].settings.level_columns)
                    splits[i] += self._choose(i, nodes, hist, columns)
            frontier = self._grow(trees, splits, level)
            level += 1
        natural = [i for i, t in trees.items() if t is not None and self.plans[i].settings.natural and t.depth]
        scale = dict.fromkeys(trees, 1.0)
        if natural:
            scale.update(self._step_sizes({i: (pending[i], trees[i]) for i in natural}))
        for i, tree in trees.items():
            if tree is not None:
                tree.value = [v * scale[i] * self.plans[i].settings.rate for v in tree.value]
        return trees

    def _step_sizes(self, trees: dict[int, tuple[list[Tree], Tree]]) -> dict[int, float]:
        """The scale of every new tree; scales beyond the first ones are tried where these do not settle it."""
        losses: dict[int, dict[float, float]] = {i: {} for i in trees}
        found: dict[int, float | None] = dict.fromkeys(trees)
        for scales in ((0.0, *self.blocks.first_scales), [k for k in SCALES if k not in self.blocks.first_scales]):
            open_trees = {i: trees[i] for i, scale in found.items() if scale is None}
            if open_trees:
                for i, x in zip(open_trees, self.blocks.add(_trials(self.plans, self.missing, scales), open_trees)):
                    losses[i].update(zip(scales, x))
                    found[i] = _step_size(losses[i])
        return found

    def _turns(self, frontier: dict[int, list[int]]) -> Iterator[dict[int, list[int]]]:
        """The open nodes in turns whose histograms stay below a bound."""
        turn: dict[int, list[int]] = {}
        size = 0
        for i, nodes in frontier.items():
            for node in nodes:
                if turn and size + self.cells[i][1] > PASS_CELLS:
                    yield turn
                    turn, size = {}, 0
                turn.setdefault(i, []).append(node)
                size += self.cells[i][1]
        if turn:
            yield turn

    @staticmethod
    def _draw(draw: np.random.Generator, columns: np.ndarray, share: float) -> np.ndarray:
        n = len(columns) if share >= 1 else max(1, round(share * len(columns)))
        return columns if n == len(columns) else np.sort(draw.choice(columns, n, replace=False))

    def _go_on(self, i: int, loss: np.ndarray, step: int, best: list) -> bool:
        """Note the losses before this tree; False once the validation loss has not fallen for ``patience`` trees."""
        train, valid = (loss[0] / loss[1] if loss[1] else math.nan), (loss[2] / loss[3] if loss[3] else math.nan)
        self.models[i].losses.append((train, valid))
        if valid != valid:
            return True
        if valid < best[i][0] - 1e-12:
            best[i] = (valid, step)
        return step - best[i][1] < self.plans[i].settings.patience

    def _choose(self, i: int, nodes: list[int], hist: np.ndarray, columns: np.ndarray) -> list[tuple]:
        """The best cut of every node, found for a few nodes at a time."""
        size = max(1, CHOICE_CELLS // self.cells[i][1])
        return [cut for at in range(0, len(nodes), size) for cut in self._best_cuts(i, nodes[at : at + size], hist[:, at : at + size], columns)]

    def _best_cuts(self, i: int, nodes: list[int], hist: np.ndarray, columns: np.ndarray) -> list[tuple]:
        """The best cut of every node: ``(node, gain, column, bin, missing_left, sums of the left and the right side)``."""
        plan, (first, total) = self.plans[i], self.cells[i]
        s = plan.settings
        sizes = np.diff(np.append(first, total))
        gap = first + sizes - 1
        column = np.repeat(np.arange(len(first)), sizes)
        cut = np.isin(column, columns)
        cut[gap] = False
        cells = np.flatnonzero(cut)
        if not len(cells):
            return []
        whole = hist[:, :, first[0] : first[0] + sizes[0]].sum(axis=2)  # 3 x nodes
        running = np.cumsum(hist, axis=2)
        before = np.where(first > 0, running[:, :, first - 1], 0.0)
        left = running[:, :, cells] - before[:, :, column[cells]]
        gaps = hist[:, :, gap[column[cells]]]
        sides = np.stack([left + gaps, left], axis=-1)  # missing rows on the left, then on the right
        other = whole[:, :, None, None] - sides
        worth = lambda x: x[0] ** 2 / np.maximum(x[1] + s.penalty, 1e-12)
        gain = worth(sides) + worth(other) - worth(whole)[:, None, None]
        ok = (np.rint(sides[2]) >= max(1, s.min_rows)) & (np.rint(other[2]) >= max(1, s.min_rows))
        gain = np.where(ok, gain, -np.inf)
        out = []
        for n, node in enumerate(nodes):
            at = int(np.argmax(gain[n]))
            cell, side = divmod(at, 2)
            if gain[n, cell, side] > LEAST_GAIN:
                c = int(column[cells[cell]])
                out.append((node, float(gain[n, cell, side]), c, int(cells[cell] - first[c]), side == 0, sides[:, n, cell, side], other[:, n, cell, side]))
        return out

    def _grow(self, trees: dict[int, Tree | None], splits: dict[int, list], level: int) -> dict[int, list[int]]:
        """Apply the cuts; the nodes that may be cut further."""
        frontier: dict[int, list[int]] = {}
        for i, found in splits.items():
            tree, plan = trees[i], self.plans[i]
            s = plan.settings
            for node, gain, column, bin_, missing_left, left, right in found:
                values = tuple(float(x[0] / max(x[1] + s.penalty, 1e-12)) for x in (left, right))
                edge = float(self.edges[plan.columns[column]][bin_])
                children = tree.split(node, column, edge, bin_, missing_left, values)
                tree.depth = level + 1
                self.models[i].gains[column] += gain
                if level + 1 < s.depth:
                    frontier.setdefault(i, []).extend(c for c, x in zip(children, (left, right)) if round(x[2]) >= 2 * max(1, s.min_rows))
        return {i: nodes for i, nodes in frontier.items() if nodes}


def _tally(plans: list[Plan]):
    """Weighted rows and events of every model's training rows."""

    def work(block: dict, _) -> list[np.ndarray]:
        out = []
        for p in plans:
            train, _ = _numbers(block, p)
            w0, w1 = p.settings.weights
            pos, n = float(train @ block["y"]), float(train.sum())
            out.append(np.array([w1 * pos + w0 * (n - pos), w1 * pos]))
        return out

    return work


def _scored(plans: list[Plan], missing: np.ndarray, starts: list[float]):
    def work(block: dict, pending: list[list[Tree]]) -> dict:
        old = block["score"]
        total = np.repeat(np.array(starts)[:, None], len(block["y"]), axis=1) if old is None else old.copy()
        for i, trees in enumerate(pending):
            x = block["x"][:, plans[i].columns] if trees else None
            for tree in trees:
                total[i] += tree.add(x, missing[plans[i].columns])
        return {**block, "score": total}

    return work


def _training(block: dict, plan: Plan) -> np.ndarray:
    rows = ~block["valid"]
    for c, value in plan.without():
        rows = rows & (block["fold"][:, c] != value)
    return rows


def _numbers(block: dict, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """How many training rows, and validation rows, of a plan each row of the block stands for."""
    n = block["n"]
    if n.ndim == 2:
        return n[:, plan.part].astype(float), n[:, -1].astype(float)
    return np.where(_training(block, plan), n, 0.0), np.where(block["valid"], n, 0.0)


def _nodes(block: dict, i: int, tree: Tree, x: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """Where the rows stand in the tree; a block that stays in the task goes on from the last level."""
    before = block.get(("nodes", i))
    at = tree.leaves(x, missing, before[1:] if before is not None and before[0] is tree else None)
    block["nodes", i] = tree, at, tree.depth
    return at


def _margin(block: dict, i: int, x: np.ndarray, trees: list[Tree], missing: np.ndarray) -> np.ndarray:
    total = block["score"][i]
    for tree in trees:
        total = total + tree.add(x, missing)
    return total


def _loss(y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, margin) - y * margin


def _histograms(plans: list[Plan], cells: list, missing: np.ndarray):
    def work(block: dict, state: tuple) -> list[np.ndarray]:
        step, level, turn = state
        out, y = [], block["y"]
        for i, (trees, tree, nodes) in turn.items():
            plan = plans[i]
            s, (first, total) = plan.settings, cells[i]
            x, gaps = block["x"][:, plan.columns], missing[plan.columns]
            margin = _margin(block, i, x, trees, gaps)
            train, valid = _numbers(block, plan)
            each = np.where(y == 1, s.weights[1], s.weights[0])
            weight, loss = each * train, np.zeros(4)
            if level == 0:
                here = _loss(y, margin)
                for k, n in ((0, train), (2, valid)):
                    loss[k], loss[k + 1] = (each * n * here)[n > 0].sum(), (each * n)[n > 0].sum()
            slot = np.full(len(tree.feature), -1)
            slot[nodes] = np.arange(len(nodes))
            at = slot[_nodes(block, i, tree, x, gaps)]
            drawn = s.rows_share >= 1 or _sampled(block["key"], s.seed * 1_000_003 + step, s.rows_share)
            chosen = np.flatnonzero((train > 0) & drawn & (at >= 0))
            p = 1 / (1 + np.exp(-np.clip(margin[chosen], -30, 30)))
            curve = p * (1 - p)
            w = weight[chosen]
            g, h = ((y[chosen] - p) / np.maximum(curve, 1e-6) * w, w) if s.natural else ((y[chosen] - p) * w, curve * w)
            index = (x[chosen].astype(np.int64) + first + (at[chosen] * total)[:, None]).ravel()
            size, d = len(nodes) * total, len(first)
            sums = [np.bincount(index, np.repeat(v, d), size) for v in (g, h)]
            sums.append(np.bincount(index, np.repeat(train[chosen], d), size))
            out.append(np.stack(sums).reshape(3, len(nodes), total))
            out.append(loss)
        return out

    return work


def _trials(plans: list[Plan], missing: np.ndarray, scales: Sequence[float]):
    """Losses of the training rows with a tree at every trial scale; 0 stands for none."""

    def work(block: dict, turn: dict) -> list[np.ndarray]:
        out, y = [], block["y"]
        for i, (trees, tree) in turn.items():
            plan = plans[i]
            train, _ = _numbers(block, plan)
            rows = train > 0
            x, gaps = block["x"][rows][:, plan.columns], missing[plan.columns]
            margin = block["score"][i][rows]
            for old in trees:
                margin = margin + old.add(x, gaps)
            move, w = tree.add(x, gaps), np.where(y[rows] == 1, plan.settings.weights[1], plan.settings.weights[0]) * train[rows]
            out.append(np.array([(w * _loss(y[rows], margin + k * move)).sum() for k in scales]))
        return out

    return work


def _step_size(losses: dict[float, float]) -> float | None:
    """Double from 1 while the loss stays below that without the tree; if it does not at 1, halve until it does.

    None if that asks for a scale without a loss.
    """
    scale, factor = 1.0, 2.0 if losses[1.0] < losses[0.0] else 0.5
    while SCALES[0] <= factor * scale <= SCALES[-1]:
        if factor * scale not in losses:
            return None
        better = losses[factor * scale] < losses[0.0]
        if factor > 1 and not better:
            return scale
        scale *= factor
        if factor < 1 and better:
            return scale
    return scale


def grow(
    df: DataFrame, columns: Sequence[str], label: str, plans: Sequence[Plan], fold: str | Sequence[str] | None = None, valid: str | None = None
) -> list[Boosted]:
    """Fit all plans over one frame; ``columns`` are numbers, ``label`` 0 or 1, both without further preparation.

    ``fold`` may name several columns; plans then have a value for each.  Plans with the same number of bins grow side by side.
    """
    names = [f"c{i}" for i in range(len(columns))]
    folds = [fold] if isinstance(fold, str) else list(fold or ())
    extra = [F.col(f"`{c}`") for c in dict.fromkeys((*folds, valid)) if c]
    frame = df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(columns, names)], F.col(f"`{label}`").cast("double").alias("_y"), *extra)
    groups: dict[int, list[int]] = {}
    for i, p in enumerate(plans):
        groups.setdefault(p.settings.bins, []).append(i)
    found: list = [None] * len(plans)
    frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        seen = frame.filter(~F.coalesce(F.col(valid).cast("boolean"), F.lit(False))) if valid else frame
        listed = few_values(seen, names, max(groups)) if len(groups) > 1 else None
        rows = None
        for bins, group in groups.items():
            edges = bin_edges(seen, names, bins, listed) if listed is not None else bin_edges(seen, names, bins)
            rows = frame.count() if rows is None else rows
            for some in _as_counted([plans[i] for i in group], group, rows * (len(names) * np.dtype(_bin_type(edges)).itemsize + 37)):
                for i, model in zip(some, _grown(frame, names, edges, [plans[i] for i in some], folds, valid, rows)):
                    found[i] = model
        return found
    finally:
        frame.unpersist()


def _as_counted(plans: Sequence[Plan], numbers: list[int], size: int) -> list[list[int]]:
    """The plans that grow over the same blocks: all over small ones, else those that sample rows by themselves."""
    if size <= BROADCAST_BYTES:
        return [numbers]
    drawn = [p.settings.rows_share < 1 for p in plans]
    return [some for s in (False, True) if (some := [i for i, d in zip(numbers, drawn) if d == s])]


def _grown(frame: DataFrame, names: list[str], edges: list[np.ndarray], plans: list[Plan], folds: list[str], valid: str | None, rows: int) -> list[Boosted]:
    """The models of plans with equal bins: over broadcast blocks or cells if these are small, else over those of all tasks."""
    kind, per_row = _bin_type(edges), sum(len(p.columns) for p in plans)
    wide = len(names) * np.dtype(kind).itemsize
    small = rows * (wide + 37) <= BROADCAST_BYTES
    if small or any(p.settings.rows_share < 1 for p in plans):
        blocks = _blocks(frame, names, edges, "_y", folds, valid, max(1, math.ceil(per_row * rows / TASK_CELLS)))
        return _each_alone(plans, edges, blocks) if small else _spread(plans, edges, blocks)
    parts = list(dict.fromkeys(p.without() for p in plans))
    plans = [replace(p, part=parts.index(p.without())) for p in plans]
    counted = _counted(frame, names, edges, "_y", folds, valid, parts).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cells = counted.agg(F.sum("n")).first()[0] or 0
        # A model's own rows are two a cell at most.
        if 2 * cells * (wide + 37) <= BROADCAST_BYTES and cells * (wide + 8 * (len(parts) + 1)) <= CELLS_FACTOR * BROADCAST_BYTES:
            return _alone_over_cells(plans, edges, [_read_chunk(r, len(names), kind) for r in counted.collect()], frame)
        blocks = counted.rdd.flatMap(lambda r: _cut(_cell_block(*_read_chunk(r, len(names), kind))))
        return _spread(plans, edges, blocks.coalesce(min(blocks.getNumPartitions(), max(1, math.ceil(2 * per_row * cells / TASK_CELLS)))))
    finally:
        counted.unpersist()


def _spread(plans: list[Plan], edges: list[np.ndarray], blocks: RDD) -> list[Boosted]:
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _Grower(plans, edges, _Spread(blocks)).run()
    finally:
        blocks.unpersist()


def _each_alone(plans: list[Plan], edges: list[np.ndarray], blocks: RDD) -> list[Boosted]:
    """A task per model over the broadcast blocks."""
    context = blocks.context
    shared = context.broadcast(blocks.collect())  # the caller has measured them

    def fit(plan: Plan) -> Boosted:
        own = Plan(list(range(len(plan.columns))), plan.settings, plan.fold)
        at_hand = _AtHand([part for block in shared.value for part in _cut(_merged(block, plan))])
        return _Grower([own], [edges[c] for c in plan.columns], at_hand).run()[0]

    try:
        return context.parallelize(plans, len(plans)).map(fit).collect()
    finally:
        shared.unpersist()


def _alone_over_cells(plans: list[Plan], edges: list[np.ndarray], chunks: list[tuple[np.ndarray, np.ndarray]], frame: DataFrame) -> list[Boosted]:
    """A task per model over the broadcast cells, of which it takes the numbers of its own rows."""
    context = frame.sparkSession.sparkContext
    shared = context.broadcast(tuple(np.concatenate(v) for v in zip(*chunks)))

    def fit(plan: Plan) -> Boosted:
        x, counts = shared.value
        x, counts = x[:, plan.columns], counts[:, [plan.part, -1]]
        if len(plan.columns) < shared.value[0].shape[1]:
            cells, counts = _added(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), counts)
            x = cells.view(x.dtype).reshape(len(cells), -1)
        own = Plan(list(range(len(plan.columns))), plan.settings)
        return _Grower([own], [edges[c] for c in plan.columns], _AtHand(_cut(_cell_block(x, counts)))).run()[0]

    try:
        return context.parallelize(plans, len(plans)).map(fit).collect()
    finally:
        shared.unpersist()


def _cut(block: dict) -> list[dict]:
    """The block in parts of at most ``BLOCK_ROWS`` rows."""
    rows = len(block["y"])
    return [{k: None if v is None else v[at : at + BLOCK_ROWS] for k, v in block.items()} for at in range(0, max(1, rows), BLOCK_ROWS)]


def _merged(block: dict, plan: Plan) -> dict:
    """The block with the columns of one model; rows that are alike in them are one row with its numbers."""
    x = np.ascontiguousarray(block["x"][:, plan.columns])
    if plan.settings.rows_share < 1 or not len(x):
        return {**block, "x": x}
    trained = _training(block, plan)
    signs = np.column_stack([block["y"] == 1, block["valid"], trained]).astype(x.dtype)
    whole = np.ascontiguousarray(np.hstack([x, signs]))
    _, first, at = np.unique(whole.view(f"V{whole.dtype.itemsize * whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
    n = np.bincount(at, block["n"], len(first))
    return {"x": x[first], "y": block["y"][first], "n": np.column_stack([n * trained[first], n * block["valid"][first]]), "score": None}


def column_matrix(batch: tuple[pd.Series, ...] | pd.Series) -> np.ndarray:
    """Rows by columns, NaN for NULL; a lone column comes without its tuple."""
    return np.column_stack([s.to_numpy(float) for s in (batch if isinstance(batch, tuple) else (batch,))])


def score_column(model: Boosted, columns: Sequence[Column]) -> Column:
    """Probability of class 1 as one vectorised expression."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            x = column_matrix(batch)
            margin = next(model.margins(x, [len(model.trees)]))
            yield pd.Series(1 / (1 + np.exp(-margin)))

    return score(*[c.cast("double") for c in columns])


def score_array(models: Sequence[Boosted], places: Sequence[Sequence[int]], columns: Sequence[Column]) -> Column:
    """Probabilities of class 1 of several models as one vectorised expression; ``places``: each model's columns among all."""

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            x = column_matrix(batch)
            margins = [next(m.margins(x[:, list(p)], [len(m.trees)])) for m, p in zip(models, places)]
            yield pd.Series(list(1 / (1 + np.exp(-np.column_stack(margins)))))

    return score(*[c.cast("double") for c in columns])
