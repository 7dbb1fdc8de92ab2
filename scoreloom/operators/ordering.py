"""Global order without a single-task window.

Three building blocks, each in two levels (bucket totals, then a window inside a bucket):

* ``shuffled_row_number`` -- 1..n in the order of a seeded md5 of the row id;
* ``running_totals``      -- prefix sums along a numeric column, one row per value;
* ``exact_quantiles``     -- linearly interpolated quantiles of many columns at once.

Buckets come from literal split points or from the hash itself, never from where a row
happens to be stored, so a recomputed task always gives the same answer.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_width

MAX_BUCKETS = 10_000
ROWS_PER_BUCKET = 200_000
MAX_SKETCH = 65_535
QUANTILE_POINTS = 256
#: A large bucket is cut into so many slices at most, at most so often, with so many points over all columns.
NARROW_SLICES, NARROW_PASSES, MAX_POINTS = 64, 2, 200_000


def row_hash(id_col: str, seed: int | str) -> Column:
    """md5 of ``seed|id``: the library's only source of randomness."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


def hash_prefix(id_col: str, seed: int | str) -> Column:
    """First 32 bits of :func:`row_hash` as a non-negative long."""
    return F.conv(F.substring(row_hash(id_col, seed), 1, 8), 16, 10).cast("long")


def hash_unit(id_col: str, seed: int | str) -> Column:
    """Deterministic number in [0, 1) per row."""
    return hash_prefix(id_col, seed) / F.lit(float(2**32))


def shuffled_row_number(
    df: DataFrame, id_col: str, seed: int | str, by: Sequence[str] = (), out: str = "rn"
) -> DataFrame:
    """Number rows 1..n in md5 order, separately for each group of ``by`` (few groups).

    The hash prefix cuts every group into equal slices, so even one group holding all rows is
    numbered by many tasks.
    """
    slices = min(MAX_BUCKETS, 4 * shuffle_width(df.sparkSession))
    tagged = df.withColumn("_h", row_hash(id_col, seed)).withColumn(
        "_slice",
        F.floor(hash_prefix(id_col, seed) * F.lit(slices) / F.lit(float(2**32))).cast("int"),
    )
    keys = [*by, "_slice"]
    counts = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    on = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    inside = Window.partitionBy(*keys).orderBy("_h", id_col)
    return (
        tagged.join(F.broadcast(offsets), on, "inner")
        .withColumn(out, F.row_number().over(inside) + F.col("_before"))
        .drop("_h", "_slice", "_before", *[f"_g{i}" for i in range(len(keys))])
    )


def running_row_numbers(df: DataFrame, id_col: str, seed: int | str, by: Sequence[str], kept: Mapping[str, Column]) -> DataFrame:
    """For every name of ``kept`` the :func:`shuffled_row_number` among the rows that its condition keeps, 0 for the others."""
    slices = min(MAX_BUCKETS, 4 * shuffle_width(df.sparkSession))
    tagged = df.withColumn("_h", row_hash(id_col, seed)).withColumn(
        "_slice",
        F.floor(hash_prefix(id_col, seed) * F.lit(slices) / F.lit(float(2**32))).cast("int"),
    )
    tagged = tagged.withColumns({name: condition.cast("int") for name, condition in kept.items()})
    keys = [*by, "_slice"]
    counts = tagged.groupBy(*keys).agg(*[F.sum(name).alias(f"_n{i}") for i, name in enumerate(kept)])
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)],
        *[F.coalesce(F.sum(f"_n{i}").over(before), F.lit(0)).alias(f"_before{i}") for i in range(len(kept))],
    )
    on = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    inside = Window.partitionBy(*keys).orderBy("_h", id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbers = {name: F.when(F.col(name) == 1, F.sum(name).over(inside) + F.col(f"_before{i}")).otherwise(0) for i, name in enumerate(kept)}
    return (
        tagged.join(F.broadcast(offsets), on, "inner")
        .withColumns(numbers)
        .drop("_h", "_slice", *[f"_before{i}" for i in range(len(kept))], *[f"_g{i}" for i in range(len(keys))])
    )


@dataclass
class ColumnStats:
    """Row count, and per column the non-null count, range and near-equal split points."""

    rows: int
    counts: dict[str, int]
    low: dict[str, float]
    high: dict[str, float]
    sketch: dict[str, list[float]]

    def points(self, column: str) -> list[float]:
        """Split points worth using: none while one task can sort the whole column."""
        return self.sketch[column] if self.counts[column] > ROWS_PER_BUCKET else []


def _sketched(df: DataFrame, columns: Sequence[str], fractions: Sequence[float], size: int) -> dict:
    """Per column number a row ``rows, n, lo, hi, q`` (``q``: near quantiles at ``fractions``), from one scan.

    Every task keeps one quantile sketch per column.  Groups of tasks merge theirs first, then each column is
    finished in a task of its own, so no task sees the sketches of all tasks or of all columns.
    """
    width = min(MAX_BUCKETS, shuffle_width(df.sparkSession))
    k, asked = F.lit(min(MAX_SKETCH, size)), F.array(*[F.lit(float(p)) for p in fractions])
    # Which tasks merge together moves only the sketched values; everything exact is counted later.
    tagged = df.select(
        (F.spark_partition_id() % width).alias("_group"),
        *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)],
    )
    exprs, cells = [F.count(F.lit(1)).alias("rows")], []
    for i in range(len(columns)):
        exprs += [
            F.count(f"x{i}").alias(f"n{i}"),
            F.min(f"x{i}").alias(f"lo{i}"),
            F.max(f"x{i}").alias(f"hi{i}"),
            F.kll_sketch_agg_double(f"x{i}", k).alias(f"s{i}"),
        ]
        cells += [F.lit(i), F.col("rows"), F.col(f"n{i}"), F.col(f"lo{i}"), F.col(f"hi{i}"), F.col(f"s{i}")]
    merged = (
        tagged.groupBy("_group")
        .agg(*exprs)
        .select(F.stack(F.lit(len(columns)), *cells).alias("var", "rows", "n", "lo", "hi", "sketch"))
        .groupBy("var")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("n").alias("n"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.kll_merge_agg_double("sketch", k).alias("sketch"),
        )
    )
    filled = F.kll_sketch_get_n_double("sketch") > 0
    quantiles = F.when(filled, F.kll_sketch_get_quantile_double("sketch", asked)).alias("q")
    return {r["var"]: r for r in merged.select("var", "rows", "n", "lo", "hi", quantiles).collect()}


def column_stats(df: DataFrame, columns: Sequence[str], pieces: int | None = None) -> ColumnStats:
    """All of :class:`ColumnStats` from one scan, with ``pieces - 1`` split points per column."""
    pieces = pieces or min(MAX_BUCKETS, shuffle_width(df.sparkSession))
    fractions = [i / pieces for i in range(1, pieces)] or [0.5]
    found = _sketched(df, columns, fractions, max(1000, 4 * pieces))

    def part(name, none=None):
        return {c: found[i][name] if i in found else none for i, c in enumerate(columns)}

    sketch = {c: sorted(set(q or [])) for c, q in part("q").items()}
    rows = max((r["rows"] for r in found.values()), default=0)
    return ColumnStats(rows, part("n", 0), part("lo"), part("hi"), sketch)


def near_quantiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float], size: int = 4000):
    """As :func:`exact_quantiles`, but straight from the sketches: ranks are off by about 0.1 %, the ends exact."""
    found = _sketched(df, columns, fractions, size)
    near = {c: dict(zip(fractions, found[i]["q"] if i in found and found[i]["q"] else [None] * len(fractions))) for i, c in enumerate(columns)}
    return near, {c: found[i]["n"] if i in found else 0 for i, c in enumerate(columns)}


def with_buckets(df: DataFrame, points: Mapping[str, Sequence[float]], suffix: str = "_bucket"):
    """Add ``<col><suffix>``: index of the half-open interval [p_i, p_i+1) holding the value."""
    flat = [c for c in points if not points[c]]
    cut = [c for c in points if points[c]]
    for c in cut:
        df = df.withColumn(f"_d_{c}", F.col(f"`{c}`").cast("double"))
    if cut:
        df = Bucketizer(
            inputCols=[f"_d_{c}" for c in cut],
            outputCols=[f"{c}{suffix}" for c in cut],
            splitsArray=[[-math.inf, *map(float, points[c]), math.inf] for c in cut],
            handleInvalid="keep",
        ).transform(df)
        df = df.withColumns({f"{c}{suffix}": F.col(f"`{c}{suffix}`").cast("int") for c in cut})
        df = df.drop(*[f"_d_{c}" for c in cut])
    return df.withColumns({f"{c}{suffix}": F.lit(0) for c in flat})


def running_totals(
    cells: DataFrame,
    order_col: str,
    sums: Sequence[str],
    points: Sequence[float],
    by: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Inclusive prefix sums ``cum_<s>`` along ``order_col`` within each group of ``by``,
    and the group's totals ``all_<s>``.

    ``cells`` has one row per group and value (pre-aggregated), ``points`` are split points of
    ``order_col``.  The offset table has one row per group and bucket and is broadcast.
    """
    tagged = with_buckets(cells, {order_col: list(points)}, "_b")
    bucket = f"{order_col}_b"
    keys = [*by, bucket]
    direction = F.col(bucket).desc() if descending else F.col(bucket).asc()
    before = Window.partitionBy(*by).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy(*keys).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    offsets = totals.select(
        *[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)],
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(Window.partitionBy(*by)).alias(f"all_{s}") for s in sums],
    )
    on = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        tagged.join(F.broadcast(offsets), on, "inner")
        .withColumns({f"cum_{s}": F.sum(s).over(inside) + F.col(f"_o_{s}") for s in sums})
        .drop(bucket, *[f"_o_{s}" for s in sums], *[f"_g{i}" for i in range(len(keys))])
    )


def _longform(df: DataFrame, points: Mapping[str, Sequence[float]]) -> DataFrame:
    """``var, bucket, value`` for every non-null value of the columns named by ``points``, in their order."""
    columns = list(points)
    tagged = with_buckets(df.select(*[F.col(f"`{c}`") for c in columns]), points)
    cells = [
        x
        for i, c in enumerate(columns)
        for x in (F.lit(i), F.col(f"`{c}_bucket`"), F.col(f"`{c}`").cast("double"))
    ]
    return tagged.select(F.stack(F.lit(len(columns)), *cells).alias("var", "bucket", "value")).filter(
        F.col("value").isNotNull()
    )


@dataclass
class Bucket:
    """One interval of a column: its first rank, row count and the smallest and largest value in it."""

    number: int
    first: int
    n: int
    low: float
    high: float

    def holds(self, ranks: Sequence[int]) -> list[int]:
        """Those of the sorted ``ranks`` that lie in this bucket."""
        return ranks[bisect_left(ranks, self.first) : bisect_left(ranks, self.first + self.n)]


def _count_buckets(df: DataFrame, points: Mapping[str, Sequence[float]]) -> dict[str, list[Bucket]]:
    """Row count and range of every bucket of every column, in one aggregation."""
    columns = list(points)
    rows = (
        _longform(df, points)
        .groupBy("var", "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        .collect()
    )
    found: dict[str, list[Bucket]] = {c: [] for c in columns}
    for r in sorted(rows, key=lambda r: (r["var"], r["bucket"])):
        done = found[columns[r["var"]]]
        first = done[-1].first + done[-1].n if done else 0
        done.append(Bucket(r["bucket"], first, r["n"], r["lo"], r["hi"]))
    return found


def _finer_points(
    points: Mapping[str, Sequence[float]],
    buckets: Mapping[str, Sequence[Bucket]],
    ranks: Mapping[str, Sequence[int]],
) -> dict[str, list[float]] | None:
    """Split points that cut only the large buckets holding a wanted rank; None when there are none."""
    large = {
        c: [b for b in buckets[c] if b.n > ROWS_PER_BUCKET and b.low < b.high and b.holds(ranks[c])] for c in points
    }
    slices = min(NARROW_SLICES, MAX_POINTS // max(1, sum(map(len, large.values()))))
    if not any(large.values()) or slices < 2:
        return None
    finer = {}
    for c in points:
        cuts = set()
        for b in large[c]:
            step = b.high / slices - b.low / slices  # the difference of the ends could overflow
            cuts.update(b.low + step * k for k in range(slices))
            cuts.add(b.high)
        finer[c] = sorted(x for x in cuts if math.isfinite(x))
    return finer


def exact_quantiles(
    df: DataFrame, fractions: Mapping[str, Sequence[float]], stats: ColumnStats | None = None
) -> tuple[dict[str, dict[float, float]], dict[str, int]]:
    """Interpolated quantiles ``{column: {p: value}}`` and non-null counts.

    Same rule as ``quantile_cont``: position ``p * (n - 1)``, linear between neighbours.  Split points of a
    sketch cut each column into buckets and one pass counts them, which shows the buckets that hold the wanted
    ranks.  Where those are still large they alone are cut again.  Only the rows left in them are sorted.
    Nothing but counts and ranks reaches the driver.
    """
    columns = list(fractions)
    stats = stats or column_stats(df, columns, QUANTILE_POINTS)
    counts = stats.counts
    at: dict[tuple[str, int], float] = {}
    ranks: dict[str, list[int]] = {}
    for c in columns:
        if not counts[c]:
            continue
        last = counts[c] - 1
        at[c, 0], at[c, last] = stats.low[c], stats.high[c]
        asked = {f(p * last) for p in fractions[c] for f in (math.floor, math.ceil)} - {0, last}
        if asked and stats.low[c] == stats.high[c]:
            at.update({(c, rank): stats.low[c] for rank in asked})
        elif asked:
            ranks[c] = sorted(asked)

    points = {c: stats.points(c) for c in ranks}
    if any(points.values()):
        buckets = _count_buckets(df, points)
        for _ in range(NARROW_PASSES):
            finer = _finer_points(points, buckets, ranks)
            if finer is None:
                break
            points, buckets = finer, _count_buckets(df, finer)
    else:
        buckets = {c: [Bucket(0, 0, counts[c], stats.low[c], stats.high[c])] for c in ranks}

    wanted: dict[tuple[int, int], tuple[Bucket, list[int]]] = {}
    for var, c in enumerate(ranks):
        for b in buckets[c]:
            held = b.holds(ranks[c])
            if held and b.low == b.high:
                at.update({(c, rank): b.low for rank in held})
            elif held:
                wanted[var, b.number] = (b, held)
    if wanted:
        at.update(_values_at(df, points, wanted))

    def between(c: str, p: float) -> float | None:
        if not counts[c]:
            return None
        pos = p * (counts[c] - 1)
        low, high = at[c, math.floor(pos)], at[c, math.ceil(pos)]
        return low + (high - low) * (pos - math.floor(pos))

    return {c: {p: between(c, p) for p in fractions[c]} for c in columns}, counts


def _values_at(
    df: DataFrame,
    points: Mapping[str, Sequence[float]],
    wanted: Mapping[tuple[int, int], tuple[Bucket, list[int]]],
) -> dict[tuple[str, int], float]:
    """Values at the wanted ranks: only the buckets that hold one are grouped by value and sorted."""
    columns = list(points)
    ranks = df.sparkSession.createDataFrame(
        [(var, number, [rank - b.first for rank in held]) for (var, number), (b, held) in wanted.items()],
        "var int, bucket int, ranks array<bigint>",
    )
    inside = Window.partitionBy("var", "bucket").orderBy("value")
    here = F.filter("ranks", lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))
    rows = _longform(df, points)
    if any(points.values()):  # without cuts every row lies in a wanted bucket
        rows = rows.join(F.broadcast(ranks.select("var", "bucket")), ["var", "bucket"], "left_semi")
    found = (
        rows.groupBy("var", "bucket", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(inside))
        .join(F.broadcast(ranks), ["var", "bucket"])
        .select("var", "bucket", "value", F.explode(here).alias("rank"))
        .collect()
    )
    return {(columns[r["var"]], r["rank"] + wanted[r["var"], r["bucket"]][0].first): r["value"] for r in found}
