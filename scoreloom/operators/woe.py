"""Weight of evidence (WOE) and information value (IV).

Numeric variables: the quantiles of every candidate bin count are found in one go, their union
cuts each variable into at most a few hundred cells, and one aggregation counts the cells of
all variables.  Every candidate binning is a union of cells, so searching for the best one
touches no data.  Categorical variables: one grouped count for all variables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..base import TableEstimator, TableModel
from ..functions.values import type_groups
from ..session import materialize, store_computed
from .encode import attach_codes, code_state, long_categories
from .ordering import QUANTILE_POINTS, ColumnStats, column_stats, exact_quantiles, near_quantiles

BIN_SCHEMA = (
    "VARNAME string, BIN int, MIN_VALUE double, MAX_VALUE double, "
    "COUNT bigint, DEFAULT bigint, NONDEFAULT bigint"
)


@dataclass
class Cells:
    """Counts of one variable between consecutive edges (right-closed), missing kept apart."""

    edges: list[float]
    count: np.ndarray
    events: np.ndarray
    total: np.ndarray
    low: np.ndarray
    high: np.ndarray
    missing: tuple[int, int]

    def group(self, edges: Sequence[float]):
        """Arrays per bin of a coarser set of edges, empty bins left out, and their bin numbers."""
        owner = np.searchsorted(np.asarray(edges, float), np.append(self.edges, math.inf), "left")
        size = len(edges) + 1
        out = {
            "count": np.bincount(owner, self.count, size),
            "events": np.bincount(owner, self.events, size),
            "total": np.bincount(owner, self.total, size),
            "low": np.full(size, math.inf),
            "high": np.full(size, -math.inf),
        }
        np.minimum.at(out["low"], owner, self.low)
        np.maximum.at(out["high"], owner, self.high)
        bins = np.flatnonzero(out["count"] > 0)
        return {k: v[bins] for k, v in out.items()}, bins


def add_cells(df: DataFrame, edges: dict[str, Sequence[float]]) -> DataFrame:
    """Add ``<col>_cell``: the number of edges below the value; NULL stays NULL."""
    used = [c for c in edges if len(edges[c])]
    # The bucketizer's intervals are closed on the left; negating makes them closed on the right.
    df = df.withColumns({f"_neg_{c}": -F.col(f"`{c}`").cast("double") for c in used})
    if used:
        df = Bucketizer(
            inputCols=[f"_neg_{c}" for c in used],
            outputCols=[f"{c}_cell" for c in used],
            splitsArray=[[-math.inf, *sorted(-float(e) for e in edges[c]), math.inf] for c in used],
            handleInvalid="keep",
        ).transform(df)
    cells = {}
    for c in edges:
        index = F.lit(len(edges[c])) - F.col(f"`{c}_cell`").cast("int") if c in used else F.lit(0)
        cells[f"{c}_cell"] = F.when(F.col(f"`{c}`").isNotNull(), index)
    return df.withColumns(cells).drop(*[f"_neg_{c}" for c in used])


def count_cells(df: DataFrame, target: str, edges: dict[str, Sequence[float]]) -> dict[str, Cells]:
    """One aggregation giving the cell counts of every variable."""
    columns = list(edges)
    tagged = add_cells(df.select(target, *[F.col(f"`{c}`") for c in columns]), edges)
    items = [
        x
        for i, c in enumerate(columns)
        for x in (F.lit(i), F.col(f"`{c}_cell`"), F.col(f"`{c}`").cast("double"))
    ]
    rows = (
        tagged.select(
            F.col(target).cast("long").alias("y"),
            F.stack(F.lit(len(columns)), *items).alias("var", "cell", "x"),
        )
        .groupBy("var", "cell")
        .agg(
            F.count("y").alias("n"),
            F.sum("y").alias("events"),
            F.sum("x").alias("total"),
            F.min("x").alias("low"),
            F.max("x").alias("high"),
        )
        .collect()
    )
    result = {}
    for i, c in enumerate(columns):
        size = len(edges[c]) + 1
        cells = Cells(
            list(edges[c]),
            np.zeros(size, dtype=np.int64),
            np.zeros(size, dtype=np.int64),
            np.zeros(size),
            np.full(size, math.inf),
            np.full(size, -math.inf),
            (0, 0),
        )
        for r in rows:
            if r["var"] != i:
                continue
            if r["cell"] is None:
                cells.missing = (r["n"], r["events"] or 0)
                continue
            k = r["cell"]
            cells.count[k], cells.events[k] = r["n"], r["events"] or 0
            cells.total[k], cells.low[k], cells.high[k] = r["total"], r["low"], r["high"]
        result[c] = cells
    return result


def average_ranks(values: np.ndarray) -> np.ndarray:
    """Ranks 1..n, ties share their mean rank."""
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[inverse]


def rank_correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Spearman's rho; NaN when one side is constant."""
    if len(a) < 2:
        return math.nan
    ra, rb = average_ranks(a), average_ranks(b)
    if np.ptp(ra) == 0 or np.ptp(rb) == 0:
        return math.nan
    return float(np.corrcoef(ra, rb)[0, 1])


def quantile_edges(quantiles: dict[float, float], bins: int) -> list[float]:
    """Interior edges of an equal-frequency binning, from already known quantiles."""
    return [quantiles[i / bins] for i in range(1, bins)]


def monotone_edges(
    cells: Cells, quantiles: dict[float, float], max_bins: int, threshold: float, force_bins: int
) -> list[float]:
    """Largest bin count whose bin means of X and Y correlate by rank; else the forced bins."""
    low, high = quantiles[0.0], quantiles[1.0]
    for n in range(max_bins, 1, -1):
        edges = quantile_edges(quantiles, n)
        if len(set([low, *edges, high])) < n + 1:
            continue
        grouped, _ = cells.group(edges)
        rho = rank_correlation(
            grouped["total"] / grouped["count"], grouped["events"] / grouped["count"]
        )
        if abs(rho) >= threshold:
            return edges
    return forced_edges(quantiles, force_bins)


def forced_edges(quantiles: dict[float, float], bins: int) -> list[float]:
    """Equal-frequency edges with repeated edges dropped."""
    low, high = quantiles[0.0], quantiles[1.0]
    return [e for e in sorted(set(quantile_edges(quantiles, bins))) if low < e < high]


def bin_rows(name: str, cells: Cells, edges: Sequence[float]) -> list[tuple]:
    """One tuple per bin in ``BIN_SCHEMA`` order; the missing bin has number -1."""
    grouped, numbers = cells.group(edges)
    rows = []
    for k, number in enumerate(numbers):
        n, events = int(grouped["count"][k]), int(grouped["events"][k])
        rows.append(
            (name, int(number), float(grouped["low"][k]), float(grouped["high"][k]), n, events, n - events)
        )
    n, events = cells.missing
    if n:
        rows.append((name, -1, None, None, n, events, n - events))
    return rows


def woe_measures(bins: DataFrame) -> DataFrame:
    """Add rates, distributions, WOE and the variable's IV to a table of bin counts.

    WOE and the IV share are 0 when exactly one class is absent from the bin and NULL when the
    variable's totals do not define them.
    """
    totals = bins.groupBy("VARNAME").agg(
        F.sum("DEFAULT").alias("_d"), F.sum("NONDEFAULT").alias("_nd")
    )
    share = bins.join(F.broadcast(totals), "VARNAME").withColumns(
        {
            "DEFAULT_RATE": F.col("DEFAULT") / F.col("COUNT"),
            "NONDEFAULT_RATE": F.col("NONDEFAULT") / F.col("COUNT"),
            "DIST_DEFAULT": F.try_divide("DEFAULT", "_d"),
            "NONDIST_DEFAULT": F.try_divide("NONDEFAULT", "_nd"),
        }
    )
    d, nd = F.col("DIST_DEFAULT"), F.col("NONDIST_DEFAULT")
    woe = (
        F.when(d.isNull() | nd.isNull() | ((d == 0) & (nd == 0)), F.lit(None).cast("double"))
        .when((d == 0) | (nd == 0), F.lit(0.0))
        .otherwise(F.ln(F.try_divide(nd, d)))
    )
    scored = share.withColumn("WOE", woe).drop("_d", "_nd")
    values = scored.groupBy("VARNAME").agg(
        F.coalesce(F.sum((nd - d) * F.col("WOE")), F.lit(0.0)).alias("IV")
    )
    return scored.join(F.broadcast(values), "VARNAME")


def category_bins(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Counts per category; missing is a category of its own (NULL)."""
    return (
        long_categories(df, columns, [target], none=False)
        .groupBy(F.col("varname").alias("VARNAME"), F.col("value").alias("VALUE"))
        .agg(F.count(target).alias("COUNT"), F.sum(F.col(target).cast("long")).alias("DEFAULT"))
        .withColumn("NONDEFAULT", F.col("COUNT") - F.col("DEFAULT"))
    )


def woe_categorical(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """WOE table of categorical variables, one row per category."""
    measured = woe_measures(category_bins(df, columns, target))
    return measured.withColumnsRenamed({"VALUE": "MIN_VALUE"}).withColumn("MAX_VALUE", F.col("MIN_VALUE"))


def numeric_edges(
    df: DataFrame,
    columns: Sequence[str],
    target: str,
    bins: int | None = None,
    max_bins: int = 20,
    corr_threshold: float = 0.8,
    force_bins: int = 3,
    approximate: bool = False,
    stats: ColumnStats | None = None,
) -> tuple[dict[str, list[float]], dict[str, Cells]]:
    """Chosen interior edges and cell counts per variable.

    ``bins`` fixes the number of equal-frequency bins; otherwise the monotone search decides.
    ``approximate`` takes the quantiles from one sketch pass instead of the exact ranks.
    """
    if bins:
        needed = {i / bins for i in range(bins + 1)}
    else:
        tried = {*range(2, max_bins + 1), force_bins}
        needed = {i / n for n in tried for i in range(n + 1)}
    if approximate:
        quantiles, counts = near_quantiles(df, columns, sorted(needed))
    else:
        quantiles, counts = exact_quantiles(df, {c: sorted(needed) for c in columns}, stats)
    filled = [c for c in columns if counts[c]]
    union = {c: sorted(set(quantiles[c].values())) if c in filled else [] for c in columns}
    cells = count_cells(df, target, union)
    chosen = {}
    for c in columns:
        if c not in filled:
            chosen[c] = []
        elif bins:
            chosen[c] = forced_edges(quantiles[c], bins)
        else:
            chosen[c] = monotone_edges(cells[c], quantiles[c], max_bins, corr_threshold, force_bins)
    return chosen, cells


MEASURED_SCHEMA = BIN_SCHEMA + "".join(
    f", {name} double"
    for name in ("DEFAULT_RATE", "NONDEFAULT_RATE", "DIST_DEFAULT", "NONDIST_DEFAULT", "WOE", "IV")
)


def measured_rows(rows: Sequence[tuple]) -> list[tuple]:
    """The bins of one variable with the measures of :func:`woe_measures`, in ``MEASURED_SCHEMA`` order."""
    events, others = sum(r[5] for r in rows), sum(r[6] for r in rows)
    measured, iv = [], 0.0
    for row in rows:
        n, bad, good = row[4:7]
        d = bad / events if events else None
        nd = good / others if others else None
        if d is None or nd is None:
            woe = None
        else:
            woe = math.log(nd / d) if d and nd else 0.0
            iv += (nd - d) * woe
        measured.append((*row, bad / n, good / n, d, nd, woe))
    return [(*row, iv) for row in measured]


def numeric_bin_table(spark, edges: dict[str, list[float]], cells: dict[str, Cells]) -> DataFrame:
    rows = [row for c in edges for row in bin_rows(c, cells[c], edges[c])]
    # A few rows per variable: one partition needs no shuffle for the measures.
    return spark.createDataFrame(rows, BIN_SCHEMA).coalesce(1)


def numeric_woe_table(spark, edges: dict[str, list[float]], cells: dict[str, Cells]) -> DataFrame:
    """Measured bins of numeric variables: a few rows per variable, computed from the counts."""
    rows = [row for c in edges for row in measured_rows(bin_rows(c, cells[c], edges[c]))]
    return spark.createDataFrame(rows, MEASURED_SCHEMA).coalesce(1)


def woe_numeric(df: DataFrame, columns: Sequence[str], target: str, **how) -> DataFrame:
    """WOE table of numeric variables; ``how`` as in :func:`numeric_edges`."""
    edges, cells = numeric_edges(df, columns, target, **how)
    return numeric_woe_table(df.sparkSession, edges, cells)


def split_kinds(df: DataFrame, columns: Sequence[str]):
    """Numeric columns with more than two distinct values (NULL is one), all others, statistics.

    A NULL next to two values, or a sketch point strictly inside the range, proves a third
    value; only columns without such proof are asked again.
    """
    numeric = type_groups(df.select(*[F.col(f"`{c}`") for c in columns]))["numerical"]
    if not numeric:
        return [], list(columns), None
    stats = column_stats(df, numeric, QUANTILE_POINTS)
    ranged = [c for c in numeric if stats.low[c] != stats.high[c]]
    wide = {
        c
        for c in ranged
        if stats.counts[c] < stats.rows or any(stats.low[c] < p < stats.high[c] for p in stats.sketch[c])
    }
    ask = [c for c in ranged if c not in wide]
    if ask:
        inside = [(F.col(f"`{c}`") > stats.low[c]) & (F.col(f"`{c}`") < stats.high[c]) for c in ask]
        row = df.agg(*[F.max(e).alias(f"b{k}") for k, e in enumerate(inside)]).first()
        wide |= {c for k, c in enumerate(ask) if row[f"b{k}"]}
    return [c for c in columns if c in wide], [c for c in columns if c not in wide], stats


def iv_summary(table: DataFrame) -> DataFrame:
    """IV per variable, largest first."""
    return (
        table.groupBy("VARNAME").agg(F.max("IV").alias("IV")).orderBy(F.desc("IV"), "VARNAME")
    )


class WoeModel(TableModel):
    """``tables['bins']`` is the full WOE table; ``transform`` adds ``<col>_woe``.

    A category not seen at fit time gives NULL.
    """

    @property
    def table(self) -> DataFrame:
        return self.tables["bins"]

    def iv(self) -> DataFrame:
        return iv_summary(self.table)

    def _transform(self, df: DataFrame) -> DataFrame:
        numeric = {}
        for c, spec in self.info["numeric"].items():
            value = F.col(f"`{c}`")
            lookup = dict(spec["woe"])
            chain = F.when(value.isNull(), F.lit(lookup.get(-1)).cast("double"))
            for number, edge in enumerate(spec["edges"]):
                chain = chain.when(value <= F.lit(edge), F.lit(lookup.get(number)).cast("double"))
            numeric[f"{c}_woe"] = chain.otherwise(F.lit(lookup.get(len(spec["edges"]))).cast("double"))
        df = df.withColumns(numeric) if numeric else df
        categorical = self.info["categorical"]
        if categorical:
            out = {c: f"{c}_woe" for c in categorical}
            df = attach_codes(
                df, self.tables["codes"], self.info["state"], categorical, out, none=False
            )
        return df


def _numeric_spec(edges: dict[str, list[float]], cells: dict[str, Cells]) -> dict:
    spec = {}
    for c in edges:
        rows = measured_rows(bin_rows(c, cells[c], edges[c]))
        spec[c] = {"edges": edges[c], "woe": [[r[1], r[-2]] for r in rows]}
    return spec


def _as_text(table: DataFrame) -> DataFrame:
    return table.withColumns({c: F.col(c).cast("string") for c in ("MIN_VALUE", "MAX_VALUE")}).drop("BIN")


def _needed(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """The columns a fit reads three times or more, stored first if they would be computed each time."""
    return store_computed(df.select(target, *[F.col(f"`{c}`") for c in columns]))


class WoeBinner(TableEstimator):
    """WOE and IV of a whole frame.

    Numeric columns with more than two distinct values are binned by quantiles (fixed ``bins``
    or the monotone search); all others get one bin per category.
    """

    def __init__(
        self,
        columns: Sequence[str],
        target: str,
        bins: int | None = None,
        max_bins: int = 20,
        corr_threshold: float = 0.8,
        force_bins: int = 3,
        approximate: bool = False,
    ):
        super().__init__()
        self.columns, self.target = list(columns), target
        self.how = {
            "approximate": approximate,
            "bins": bins,
            "max_bins": max_bins,
            "corr_threshold": corr_threshold,
            "force_bins": force_bins,
        }

    def _fit(self, df: DataFrame) -> WoeModel:
        df = _needed(df, self.columns, self.target)
        numeric, categorical, stats = split_kinds(df, self.columns)
        info = {"numeric": {}, "categorical": categorical}
        parts, tables = [], {}
        if numeric:
            edges, cells = numeric_edges(df, numeric, self.target, stats=stats, **self.how)
            info["numeric"] = _numeric_spec(edges, cells)
            parts.append(_as_text(numeric_woe_table(df.sparkSession, edges, cells)))
        if categorical:
            table = materialize(woe_categorical(df, categorical, self.target))
            tables["codes"] = table.select(
                F.col("VARNAME").alias("varname"),
                F.col("MIN_VALUE").alias("value"),
                F.col("COUNT").alias("n"),
                F.col("WOE").alias("code"),
            )
            info["state"] = code_state(tables["codes"])
            parts.append(table)
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        tables["bins"] = whole
        return WoeModel(info, tables)


def grow_bins(count: np.ndarray, events: np.ndarray, max_bins: int, min_share: float, min_gain: float):
    """Greedy supervised cuts over ordered cells: each step takes the cut with the largest IV.

    Returns the positions (cells before the cut).  Stops at ``max_bins``, when no cut leaves
    ``min_share`` of the rows on both sides, or when the IV grows by less than ``min_gain``.
    """
    good = count - events
    all_events, all_good, rows = events.sum(), good.sum(), count.sum()
    if not all_events or not all_good:
        return []
    run_e = np.concatenate([[0], np.cumsum(events)])
    run_g = np.concatenate([[0], np.cumsum(good)])

    def part(a, b):
        e = (run_e[b] - run_e[a]) / all_events
        g = (run_g[b] - run_g[a]) / all_good
        with np.errstate(divide="ignore", invalid="ignore"):
            value = (g - e) * np.log(g / e)
        return np.where((e > 0) & (g > 0), value, 0.0)

    cuts, last = [], len(count)
    iv = 0.0
    while len(cuts) + 1 < max_bins:
        borders = [0, *sorted(cuts), last]
        best = (0.0, None)
        for a, b in zip(borders[:-1], borders[1:]):
            where = np.arange(a + 1, b)
            left = run_e[where] + run_g[where] - run_e[a] - run_g[a]
            right = run_e[b] + run_g[b] - run_e[where] - run_g[where]
            where = where[(left >= min_share * rows) & (right >= min_share * rows)]
            if len(where):
                gain = part(a, where) + part(where, b) - part(a, b)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-15:
                    best = (float(gain[k]), int(where[k]))
        if best[1] is None or (cuts and best[0] < min_gain * iv):
            break
        cuts.append(best[1])
        iv += best[0]
    return sorted(cuts)


class TreeWoeBinner(TableEstimator):
    """Supervised binning by greedy IV splits, at most ``max_bins`` bins per variable.

    Numeric variables are split over fine quantile cells.  Categories are ordered by event rate
    and split along that order, so similar categories share a bin.  Missing is its own bin.
    """

    def __init__(
        self,
        columns: Sequence[str],
        target: str,
        max_bins: int = 20,
        min_share: float = 0.05,
        min_gain: float = 0.1,
        cells: int = 128,
    ):
        super().__init__()
        self.columns, self.target, self.cells = list(columns), target, cells
        self.rules = (max_bins, min_share, min_gain)

    def _fit(self, df: DataFrame) -> WoeModel:
        df = _needed(df, self.columns, self.target)
        numeric, categorical, stats = split_kinds(df, self.columns)
        info = {"numeric": {}, "categorical": categorical}
        parts, tables = [], {}
        if numeric:
            _, cells = numeric_edges(df, numeric, self.target, bins=self.cells, stats=stats)
            edges = {}
            for c in numeric:
                cuts = grow_bins(cells[c].count, cells[c].events, *self.rules)
                edges[c] = [cells[c].edges[k - 1] for k in cuts]
            info["numeric"] = _numeric_spec(edges, cells)
            parts.append(_as_text(numeric_woe_table(df.sparkSession, edges, cells)))
        if categorical:
            grouped = materialize(self._category_groups(df, categorical))
            bins = (
                grouped.groupBy("VARNAME", "BIN")
                .agg(
                    F.min("VALUE").alias("MIN_VALUE"),
                    F.max("VALUE").alias("MAX_VALUE"),
                    *[F.sum(m).alias(m) for m in ("COUNT", "DEFAULT", "NONDEFAULT")],
                )
            )
            table = materialize(woe_measures(bins))
            tables["codes"] = materialize(
                grouped.join(F.broadcast(table.select("VARNAME", "BIN", "WOE")), ["VARNAME", "BIN"]).select(
                    F.col("VARNAME").alias("varname"),
                    F.col("VALUE").alias("value"),
                    F.col("COUNT").alias("n"),
                    F.col("WOE").alias("code"),
                )
            )
            info["state"] = code_state(tables["codes"])
            parts.append(table.drop("BIN"))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return WoeModel(info, {**tables, "bins": whole})

    def _category_groups(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Category counts with the number of the bin each category falls into (-1: missing)."""
        counts = materialize(category_bins(df, columns, self.target))
        rate = F.col("DEFAULT") / F.col("COUNT")
        known = counts.filter(F.col("VALUE").isNotNull()).withColumn("_rate", rate)
        fractions = [i / self.cells for i in range(1, self.cells + 1)]
        edges = known.groupBy("VARNAME").agg(
            F.array_sort(F.array_distinct(F.percentile_approx("_rate", fractions))).alias("_edges")
        )
        below = F.size(F.filter("_edges", lambda e: e < F.col("_rate")))
        cells = (
            known.join(F.broadcast(edges), "VARNAME")
            .groupBy("VARNAME", "_edges", below.alias("_cell"))
            .agg(F.sum("COUNT").alias("n"), F.sum("DEFAULT").alias("e"))
            .collect()
        )
        cuts = []
        for name in columns:
            mine = [r for r in cells if r["VARNAME"] == name]
            if not mine:
                continue
            limits = mine[0]["_edges"]
            n, e = np.zeros(len(limits) + 1, np.int64), np.zeros(len(limits) + 1, np.int64)
            for r in mine:
                n[r["_cell"]], e[r["_cell"]] = r["n"], r["e"]
            cuts.append((name, [float(limits[k - 1]) for k in grow_bins(n, e, *self.rules)]))
        table = df.sparkSession.createDataFrame(cuts, "VARNAME string, _cuts array<double>")
        number = F.size(F.filter("_cuts", lambda c: rate > c))
        return (
            counts.join(F.broadcast(table), "VARNAME", "left")
            .withColumn("BIN", F.when(F.col("VALUE").isNull(), -1).otherwise(number))
            .drop("_cuts")
        )


def var_filter(
    df: DataFrame,
    columns: Sequence[str],
    target: str,
    iv_limit: float = 0.02,
    missing_limit: float = 0.95,
    identical_limit: float = 0.95,
    **how,
) -> DataFrame:
    """Per variable: missing fraction, share of the most common value, IV, and ``keep``."""
    rows = F.lit(df.count())
    common = (
        long_categories(df, columns, [], none=False)
        .groupBy(F.col("varname").alias("VARNAME"), "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("VARNAME")
        .agg(
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
            F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("top"),
        )
    )
    iv = WoeBinner(columns, target, **how).fit(df).iv()
    checked = common.join(F.broadcast(iv), "VARNAME").select(
        "VARNAME",
        (F.col("missing") / rows).alias("missing_fraction"),
        F.try_divide(F.col("top"), rows - F.col("missing")).alias("dominant_share"),
        F.col("IV").alias("iv"),
    )
    keep = (
        (F.col("missing_fraction") <= missing_limit)
        & (F.coalesce(F.col("dominant_share"), F.lit(1.0)) <= identical_limit)
        & (F.col("iv") >= iv_limit)
    )
    return checked.withColumn("keep", keep)
