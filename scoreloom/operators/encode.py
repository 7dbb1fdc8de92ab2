"""Categorical encoders.

All of them reduce to one grouped aggregation over ``(varname, value[, fold])`` for all columns
together.  Out-of-fold values come from subtracting a fold's sums from the totals, so there is
no loop over folds, and the rows of a frequent category are combined before the shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder as VectorOneHot
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..base import TableEstimator, TableModel
from ..functions.missing import quoted
from ..session import materialize
from .lookup import BROADCAST_BYTES, attach
from .ordering import column_stats, running_totals
from .split import hash_fold, stratified_fold

NONE = "none"


def category_value(name: str, none: bool = True) -> Column:
    """The category as text; with ``none``, missing is the category ``none``."""
    text = f"CAST({quoted(name)} AS STRING)"
    return F.expr(f"coalesce({text}, '{NONE}')" if none else text)


def long_categories(df: DataFrame, columns: Sequence[str], keep: Sequence[str], none: bool = True) -> DataFrame:
    """``(varname, value, *keep)``: one row per cell of the categorical columns."""
    cells = [x for c in columns for x in (F.lit(c), category_value(c, none))]
    return df.select(*keep, F.stack(F.lit(len(columns)), *cells).alias("varname", "value"))


# A variable with at most this many codes is applied as a constant map, without a join.
MAP_ENTRIES = 256


def code_state(codes: DataFrame) -> dict:
    """How to apply a code table ``(varname, value, [_fold], n, code)``, per variable.

    ``maps`` holds the codes of variables with few of them; ``sizes`` the measured bytes of the
    others, which are joined.
    """
    width = 16 * len(codes.columns)
    grouped = codes.groupBy("varname").agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum(F.coalesce(F.length("value"), F.lit(0)) + F.lit(width)).alias("bytes"),
    ).collect()
    few = [r["varname"] for r in grouped if r["entries"] <= MAP_ENTRIES]
    maps: dict[str, list] = {c: [] for c in few}
    if few:
        for r in codes.filter(F.col("varname").isin(few)).collect():
            fold = r["_fold"] if "_fold" in codes.columns else None
            maps[r["varname"]].append([r["value"], fold, r["code"]])
    return {"maps": maps, "sizes": {r["varname"]: int(r["bytes"]) for r in grouped}}


def _map_lookup(entries: list, value: Column, fold: str | None) -> Column:
    """The code as a projection; NULL for anything not listed."""
    kind = "bigint" if all(isinstance(e[2], int) for e in entries) else "double"
    if fold is None:
        flat = {e[0]: e[2] for e in entries if e[0] is not None}
        table = F.from_json(F.lit(json.dumps(flat)), f"map<string,{kind}>")
        found = F.try_element_at(table, value)
        missing = [e[2] for e in entries if e[0] is None]
        return F.when(value.isNull(), F.lit(missing[0] if missing else None).cast(kind)).otherwise(found)
    size = 1 + max(e[1] for e in entries)
    by_fold: dict[str, list] = {}
    for v, k, code in entries:
        by_fold.setdefault(v, [None] * size)[k] = code
    table = F.from_json(F.lit(json.dumps(by_fold)), f"map<string,array<{kind}>>")
    return F.get(F.try_element_at(table, value), F.col(fold))


def attach_codes(
    df: DataFrame,
    codes: DataFrame,
    state: dict,
    columns: Sequence[str],
    out: dict[str, str],
    fold: str | None = None,
    none: bool = True,
    limit_bytes: int | None = None,
) -> DataFrame:
    """Add each column's ``code``; ``state`` as given by :func:`code_state`.

    ``limit_bytes`` (``BROADCAST_BYTES`` if None) holds for all columns together: tables are broadcast from the smallest on while their sum stays
    below it, the others are joined.
    """
    mapped = {
        out[c]: _map_lookup(state["maps"][c], category_value(c, none), fold)
        for c in columns
        if c in state["maps"]
    }
    df = df.withColumns(mapped) if mapped else df
    keys = [fold] if fold else []
    left = BROADCAST_BYTES if limit_bytes is None else limit_bytes
    small = set()
    for c in sorted((c for c in columns if c not in state["maps"]), key=lambda c: state["sizes"].get(c, 0)):
        left -= state["sizes"].get(c, 0)
        if left < 0:
            break
        small.add(c)
    for c in columns:
        if c in state["maps"]:
            continue
        table = codes.filter(F.col("varname") == c).select(
            F.col("value").alias("_value"), *keys, "n", F.col("code").alias(out[c])
        )
        df = attach(
            df.withColumn("_value", category_value(c, none)),
            table,
            ["_value", *keys],
            weight="n",
            # A column without a table (nothing was learned) counts as empty.
            limit_bytes=0,
            measured=0 if c in small else max(1, state["sizes"].get(c, 0)),
        ).drop("_value")
    return df


class CodeModel(TableModel):
    """Adds ``<col><suffix>`` from a code table, with a default for unseen categories."""

    def _transform(self, df: DataFrame) -> DataFrame:
        info = self.info
        out = {c: f"{c}{info['suffix']}" for c in info["columns"]}
        df = attach_codes(df, self.tables["codes"], info["state"], info["columns"], out)
        return df.withColumns(
            {out[c]: F.coalesce(F.col(f"`{out[c]}`"), F.lit(info["default"])) for c in info["columns"]}
        )


class FrequencyEncoder(TableEstimator):
    """Share of training rows holding the category; unseen gives 0."""

    def __init__(self, columns: Sequence[str]):
        super().__init__()
        self.columns = list(columns)

    def _fit(self, df: DataFrame) -> CodeModel:
        counts = long_categories(df, self.columns, []).groupBy("varname", "value").agg(
            F.count(F.lit(1)).alias("n")
        )
        # Each variable's counts add up to the number of rows.
        totals = counts.groupBy("varname").agg(F.sum("n").alias("rows"))
        codes = materialize(
            counts.join(F.broadcast(totals), "varname").select(
                "varname", "value", "n", (F.col("n") / F.col("rows")).alias("code")
            )
        )
        return CodeModel(
            {"columns": self.columns, "suffix": "_freq", "default": 0.0, "state": code_state(codes)},
            {"codes": codes},
        )


class LabelEncoder(TableEstimator):
    """0, 1, 2, ... in the order of first appearance (smallest id); unseen gives -1."""

    def __init__(self, columns: Sequence[str], id_col: str):
        super().__init__()
        self.columns, self.id_col = list(columns), id_col

    def _fit(self, df: DataFrame) -> CodeModel:
        firsts = materialize(
            long_categories(df, self.columns, [self.id_col])
            .groupBy("varname", "value")
            .agg(
                F.min(self.id_col).alias("first_id"),
                F.count(F.lit(1)).alias("n"),
                F.lit(1).cast("long").alias("one"),
            )
        )
        points = column_stats(firsts, ["first_id"]).points("first_id")
        ranked = running_totals(firsts, "first_id", ["one"], points, by=["varname"])
        codes = materialize(
            ranked.select("varname", "value", "n", (F.col("cum_one") - 1).cast("long").alias("code"))
        )
        return CodeModel(
            {"columns": self.columns, "suffix": "_labeled", "default": -1, "state": code_state(codes)},
            {"codes": codes},
        )


class OneHotModel(TableModel):
    """Adds one 0/1 column per category, or one sparse vector per variable."""

    def _transform(self, df: DataFrame) -> DataFrame:
        if "categories" in self.info:
            flags = {
                f"{c}_ohe_{v}": (category_value(c) == F.lit(v)).cast("double")
                for c, values in self.info["categories"].items()
                for v in values
            }
            return df.withColumns(flags)
        columns = self.info["columns"]
        indexed = CodeModel(self.info, self.tables).transform(df)
        for c in columns:
            size = self.info["cardinality"][c]
            index = f"{c}_labeled"
            # An unseen category takes the index past the last one, which dropLast leaves empty.
            indexed = indexed.withColumn(
                index, F.when(F.col(index) < 0, size).otherwise(F.col(index)).cast("double")
            )
            indexed = self._vector(indexed, index, f"{c}_ohe", size).drop(index)
        return indexed

    @staticmethod
    def _vector(df: DataFrame, index: str, out: str, size: int) -> DataFrame:
        template = df.sparkSession.range(1).select(F.lit(float(size)).alias(index))
        encoder = VectorOneHot(inputCols=[index], outputCols=[out], dropLast=True)
        return encoder.fit(template).transform(df)


class OneHotEncoder(TableEstimator):
    """One-hot encoding; unseen categories give all zeros.

    ``output="columns"`` makes a column per category, named after it and sorted; ``"vector"`` makes one
    sparse vector per variable in first-appearance order, for any cardinality.  The data never decide.
    """

    def __init__(self, columns: Sequence[str], id_col: str, output: str = "columns"):
        super().__init__()
        if output not in ("columns", "vector"):
            raise ValueError("output is 'columns' or 'vector'")
        self.columns, self.id_col, self.output = list(columns), id_col, output

    def _fit(self, df: DataFrame) -> OneHotModel:
        if self.output == "columns":
            head = long_categories(df, self.columns, []).distinct().collect()  # one row per output column
            found = {c: sorted(r["value"] for r in head if r["varname"] == c) for c in self.columns}
            return OneHotModel({"categories": found})
        labels = LabelEncoder(self.columns, self.id_col).fit(df)
        sizes = labels.tables["codes"].groupBy("varname").agg(F.max("code").alias("m")).collect()
        info = dict(labels.info, cardinality={r["varname"]: int(r["m"]) + 1 for r in sizes})
        return OneHotModel(info, labels.tables)


class MeanModel(TableModel):
    """``transform`` uses the full-train means; ``transform_train`` the out-of-fold ones."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, "codes", None)

    def transform_train(self, df: DataFrame) -> DataFrame:
        info = self.info
        if not info["folds"]:
            return self.transform(df)
        folded = stratified_fold(df, info["id_col"], info["target"], info["folds"], info["seed"], "_fold")
        return self._apply(folded, "fold_codes", "_fold").drop("_fold")

    def _apply(self, df: DataFrame, table: str, fold: str | None) -> DataFrame:
        info = self.info
        out = {c: f"{c}{info['suffix']}" for c in info["columns"]}
        df = attach_codes(df, self.tables[table], info[f"{table}_state"], info["columns"], out, fold)
        return df.withColumns(
            {o: F.coalesce(F.col(f"`{o}`"), F.lit(info["default"])) for o in out.values()}
        )


class MeanEncoder(TableEstimator):
    """Smoothed target mean ``(sum + global * alpha) / (n + alpha)`` per category.

    With ``folds`` the training rows get the mean of the other stratified folds.  ``default``
    replaces the global mean for unseen categories.
    """

    def __init__(
        self,
        columns: Sequence[str],
        target: str,
        alpha: float = 0.0,
        folds: int | None = None,
        id_col: str | None = None,
        seed: int = 913100,
        default: float | None = None,
        suffix: str = "_mean",
    ):
        super().__init__()
        if folds and not id_col:
            raise ValueError("out-of-fold encoding needs id_col")
        self.columns, self.target, self.alpha, self.folds = list(columns), target, alpha, folds
        self.id_col, self.seed, self.default, self.suffix = id_col, seed, default, suffix

    def _fit(self, df: DataFrame) -> MeanModel:
        keys = ["varname", "value"]
        if self.folds:
            df = stratified_fold(df, self.id_col, self.target, self.folds, self.seed, "_fold")
            keys.append("_fold")
        label = F.col(self.target).cast("double")
        sums = materialize(
            long_categories(df, self.columns, [self.target, *keys[2:]])
            .groupBy(*keys)
            .agg(F.count(label).alias("n"), F.sum(label).alias("s"))
        )
        first = sums.filter(F.col("varname") == self.columns[0])
        mean = first.agg(F.sum("s") / F.sum("n")).first()[0]
        prior = F.lit(float(mean * self.alpha))
        alpha = F.lit(float(self.alpha))
        full = sums.groupBy("varname", "value").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        codes = materialize(
            full.select(
                "varname", "value", "n", F.try_divide(F.col("s") + prior, F.col("n") + alpha).alias("code")
            )
        )
        info = {
            "columns": self.columns,
            "target": self.target,
            "suffix": self.suffix,
            "folds": self.folds,
            "id_col": self.id_col,
            "seed": self.seed,
            "default": float(mean if self.default is None else self.default),
            "codes_state": code_state(codes),
        }
        tables = {"codes": codes}
        if self.folds:
            # At most ``folds`` rows per category: this window never sees a large group.
            whole = Window.partitionBy("varname", "value")
            rest_n = F.sum("n").over(whole) - F.col("n")
            rest_s = F.sum("s").over(whole) - F.col("s")
            tables["fold_codes"] = materialize(
                sums.select(
                    *keys,
                    "n",
                    F.when(rest_n > 0, (rest_s + prior) / (rest_n + alpha)).alias("code"),
                )
            )
            info["fold_codes_state"] = code_state(tables["fold_codes"])
        return MeanModel(info, tables)


class KFoldTargetModel(TableModel):
    """Replaces the column: ``transform_train`` out of fold, ``transform`` for other frames."""

    def transform_train(self, df: DataFrame) -> DataFrame:
        info = self.info
        folded = hash_fold(df, info["id_col"], info["folds"], info["seed"], "_fold")
        return self._apply(folded, "fold_codes", "_fold", {}).drop("_fold")

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, "codes", None, self.info["means"])

    def _apply(self, df: DataFrame, table: str, fold: str | None, defaults: dict) -> DataFrame:
        columns = self.info["columns"]
        out = {c: f"_te_{c}" for c in columns}
        coded = attach_codes(
            df, self.tables[table], self.info[f"{table}_state"], columns, out, fold, none=False
        )
        picked = {}
        for c in columns:
            unseen = F.when(F.col(f"`{c}`").isNotNull(), F.lit(defaults.get(c)).cast("double"))
            picked[c] = F.coalesce(F.col(f"`{out[c]}`"), unseen)
        return coded.withColumns(picked).drop(*out.values())


class KFoldTargetEncoder(TableEstimator):
    """K-fold target means that overwrite the column.

    A training row gets its category's mean over the other folds, or the full mean when the
    category lives in its fold only.  Other frames get the mean of the encoded training values
    per category; unseen categories the mean of the whole encoded column; NULL stays NULL.
    """

    def __init__(self, columns: Sequence[str], target: str, id_col: str, folds: int = 5, seed: int = 10000):
        super().__init__()
        self.columns, self.target, self.id_col = list(columns), target, id_col
        self.folds, self.seed = folds, seed

    def _fit(self, df: DataFrame) -> KFoldTargetModel:
        folded = hash_fold(df, self.id_col, self.folds, self.seed, "_fold")
        label = F.col(self.target).cast("double")
        sums = (
            long_categories(folded, self.columns, [self.target, "_fold"], none=False)
            .filter(F.col("value").isNotNull())
            .groupBy("varname", "value", "_fold")
            .agg(F.count(label).alias("n"), F.sum(label).alias("s"))
        )
        whole = Window.partitionBy("varname", "value")
        all_n, all_s = F.sum("n").over(whole), F.sum("s").over(whole)
        rest_n = all_n - F.col("n")
        code = F.when(rest_n > 0, F.try_divide(all_s - F.col("s"), rest_n)).otherwise(
            F.try_divide(all_s, all_n)
        )
        fold_codes = materialize(sums.select("varname", "value", "_fold", "n", code.alias("code")))
        weighted = F.sum(F.col("n") * F.col("code"))
        codes = materialize(
            fold_codes.groupBy("varname", "value")
            .agg(F.sum("n").alias("n"), weighted.alias("_w"))
            .select("varname", "value", "n", (F.col("_w") / F.col("n")).alias("code"))
        )
        means = codes.groupBy("varname").agg((weighted / F.sum("n")).alias("m")).collect()
        info = {
            "columns": self.columns,
            "id_col": self.id_col,
            "folds": self.folds,
            "seed": self.seed,
            "means": {r["varname"]: r["m"] for r in means},
            "codes_state": code_state(codes),
            "fold_codes_state": code_state(fold_codes),
        }
        return KFoldTargetModel(info, {"codes": codes, "fold_codes": fold_codes})


def unseen_categories(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """Distinct categories of ``test`` that ``train`` does not have."""
    seen = train.select(column).distinct()
    return test.select(column).distinct().join(seen, column, "left_anti").filter(F.col(column).isNotNull())


def mask_unseen(train: DataFrame, test: DataFrame, column: str, value: str) -> DataFrame:
    """``test`` with categories absent from ``train`` overwritten by ``value``."""
    seen = materialize(
        train.filter(F.col(f"`{column}`").isNotNull())
        .groupBy(F.col(f"`{column}`").alias("_key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_seen", F.lit(True))
    )
    tagged = attach(test.withColumn("_key", F.col(f"`{column}`")), seen, ["_key"], weight="n")
    kept = F.when(F.col("_seen") | F.col(f"`{column}`").isNull(), F.col(f"`{column}`"))
    return tagged.withColumn(column, kept.otherwise(F.lit(value))).drop("_key", "_seen")


def shared_categories(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """Distinct categories present in both frames."""
    return train.select(column).intersect(test.select(column)).filter(F.col(column).isNotNull())
