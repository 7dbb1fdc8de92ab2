"""Declarative cleaning and feature-extraction recipes for a train / test pair.

``fit`` learns every small state from the training frame; ``transform`` is one lazy plan of
projections and lookups, identical for both frames.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..base import TableEstimator, TableModel
from ..functions import missing, text, values
from ..operators.encode import MeanEncoder, MeanModel
from ..operators.impute import hot_deck_fill
from ..operators.lookup import attach, estimated_bytes
from ..operators.missing import DropByMissingRate, DropConstant
from ..operators.profile import drop_high_corr
from ..operators.woe import TreeWoeBinner, WoeModel, var_filter
from ..session import materialize


@dataclass
class CleaningSpec:
    """What to clean; columns a frame lacks (or lost for missing values) are skipped."""

    id_col: str = "id"
    label: str = "label"
    sentinels: Sequence = tuple(missing.INGEST_PATTERNS)
    rename_prefix: str | None = None
    rename_count: int = 0
    missing_rate: float = 0.8
    indicator_corr: float = 0.8
    names: Sequence[str] = ()
    unknown: Sequence[str] = ()
    lower: Sequence[str] = ()
    known_only: Sequence[str] = ()
    lists: Sequence[str] = ()
    list_elements: Mapping[str, Sequence[str]] = field(default_factory=dict)
    composites: Mapping[str, Sequence[str]] = field(default_factory=dict)
    ordinals: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    mean_encoded: Sequence[str] = ()
    whitelists: Mapping[str, Sequence] = field(default_factory=dict)
    numbers: Sequence[str] = ()
    coalesced: Mapping[str, Sequence[str]] = field(default_factory=dict)


class CleaningModel(TableModel):
    """Applies the learned recipe; works with and without the label column."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._finish(self._prepare(df))

    @property
    def spec(self) -> CleaningSpec:
        return CleaningSpec(**self.info["spec"])

    def _raw(self, df: DataFrame) -> DataFrame:
        spec = self.spec
        df = missing.null_out(df, spec.sentinels, skip=[spec.id_col, spec.label])
        if spec.rename_prefix:
            df = values.number_columns(df, spec.rename_prefix, spec.rename_count)
        return df

    def _indicators(self, df: DataFrame) -> DataFrame:
        """Drop sparse columns, add the kept indicators and the count of missing cells."""
        info, spec = self.info, self.spec
        df = df.drop(*info["sparse"])
        features = [c for c in df.columns if c not in (spec.id_col, spec.label)]
        flags = missing.indicators(df, features)
        kept = {k: v for k, v in flags.items() if k in info["indicators"]}
        return df.withColumns({**kept, "incomplete": missing.missing_count(features)})

    def _categorical(self, df: DataFrame) -> DataFrame:
        spec, have = self.spec, set(df.columns)
        filled = {}
        for c in spec.unknown:
            if c in have:
                filled[c] = text.fill_unknown(F.col(f"`{c}`").cast("string"), c)
        for c in spec.names:
            if c in have:
                raw = text.fill_unknown(F.col(f"`{c}`").cast("string"), c.lower())
                filled[c] = text.normalize_name(raw)
        for c in spec.lower:
            if c in have:
                filled[c] = F.lower(filled.get(c, F.col(f"`{c}`")))
        for c in spec.lists:
            if c in have:
                filled[c] = text.parse_list(F.col(f"`{c}`"))
        return df.withColumns(filled) if filled else df

    def _prepare(self, df: DataFrame) -> DataFrame:
        """Everything up to the point where target means are attached."""
        spec, info = self.spec, self.info
        df = self._categorical(self._indicators(self._raw(df)))
        for c in spec.known_only:
            if c in df.columns:
                seen = self.tables[f"seen_{c}"]
                tagged = attach(
                    df.withColumn("_key", F.col(f"`{c}`")), seen, ["_key"], "n",
                    measured=info["seen_bytes"][c],
                )
                known = F.when(F.col("_seen"), F.col(f"`{c}`")).otherwise(F.lit(f"unk_{c}"))
                df = tagged.withColumn(c, known).drop("_key", "_seen")
        for out, parts in spec.composites.items():
            if all(p in df.columns for p in parts):
                df = df.withColumn(out, values.composite([F.col(f"`{p}`") for p in parts]))
        for c in spec.lists:
            if c in df.columns:
                counts = {f"{c}_count": F.size(F.col(f"`{c}`"))}
                for e in info["elements"].get(c, []):
                    counts[f"{c}_count_{e}"] = text.element_count(F.col(f"`{c}`"), e)
                df = df.withColumns(counts)
        for c, mapping in spec.ordinals.items():
            if c in df.columns:
                df = df.withColumn(c, values.map_values(F.col(f"`{c}`"), mapping, -1))
        return df

    def _finish(self, df: DataFrame) -> DataFrame:
        spec = self.spec
        if "means" in self.tables:
            df = MeanModel(self.info["means"], {"codes": self.tables["means"]}).transform(df)
        numbers = {}
        for c in spec.numbers:
            if c in df.columns:
                numbers[c] = F.col(f"`{c}`").try_cast("double")
        for c, allowed in spec.whitelists.items():
            if c in df.columns:
                numbers[c] = missing.keep_listed(F.col(f"`{c}`").try_cast("double"), allowed)
        for out, sources in spec.coalesced.items():
            if all(s in df.columns for s in sources):
                numbers[out] = F.coalesce(*[F.col(f"`{s}`") for s in sources])
        df = df.withColumns(numbers) if numbers else df
        return values.cast_numeric(df, skip=[spec.id_col, spec.label])


class CleaningRecipe(TableEstimator):
    """Learns the cleaning recipe.  ``others`` are frames whose list elements also count:
    a multiplicity column is made for elements present in the training frame and in them."""

    def __init__(self, spec: CleaningSpec, other: DataFrame | None = None):
        super().__init__()
        self.spec, self.other = spec, other

    def _fit(self, train: DataFrame) -> CleaningModel:
        spec = self.spec
        plain = {k: _plain(v) for k, v in asdict(spec).items()}
        model = CleaningModel({"spec": plain, "sparse": [], "indicators": [], "elements": {}, "seen_bytes": {}})
        fixed = [spec.id_col, spec.label]
        raw = model._raw(train)
        model.info["sparse"] = DropByMissingRate(spec.missing_rate, [], keep=fixed).fit(raw).dropped
        dense = raw.drop(*model.info["sparse"])
        features = [c for c in dense.columns if c not in fixed]
        flags = dense.select(*[e.alias(n) for n, e in missing.indicators(dense, features).items()])
        constant = DropConstant().fit(flags).dropped
        varying = [c for c in flags.columns if c not in constant]
        related = drop_high_corr(flags, varying, spec.indicator_corr).dropped if varying else []
        model.info["indicators"] = [c for c in varying if c not in related]

        cleaned = model._categorical(model._indicators(raw))
        for c in spec.known_only:
            if c in cleaned.columns:
                seen = materialize(
                    cleaned.groupBy(F.col(f"`{c}`").alias("_key"))
                    .agg(F.count(F.lit(1)).alias("n"))
                    .withColumn("_seen", F.lit(True))
                )
                model.tables[f"seen_{c}"] = seen
                model.info["seen_bytes"][c] = estimated_bytes(seen)
        for c in spec.lists:
            if c in cleaned.columns:
                found = cleaned.select(F.explode(F.col(f"`{c}`")).alias("e")).distinct()
                if self.other is not None:
                    theirs = model._categorical(model._indicators(model._raw(self.other)))
                    found = found.intersect(theirs.select(F.explode(F.col(f"`{c}`")).alias("e")))
                # Every element becomes a column; name them in list_elements to have only some.
                given = spec.list_elements.get(c)
                model.info["elements"][c] = sorted(given if given is not None else (r["e"] for r in found.collect()))
        prepared = model._prepare(train)
        encoded = [c for c in spec.mean_encoded if c in prepared.columns]
        if encoded:
            means = MeanEncoder(encoded, spec.label, default=-1.0, suffix="_te").fit(prepared)
            model.info["means"] = means.info
            model.tables["means"] = means.tables["codes"]
        return model


def _plain(value):
    """Tuples become lists so that settings survive JSON."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


class ExtractionModel(TableModel):
    """Adds ``<col>_woe``; cells without a WOE are drawn from a training row."""

    def __init__(self, binner, train_woe: DataFrame, info: dict):
        super().__init__(info)
        self.binner, self.train_woe = binner, train_woe

    def save(self, path: str) -> None:
        """Bins, training cells and settings; ``load`` reads all of them."""
        self.tables = {"train_woe": self.train_woe}
        super().save(path)
        if self.info["columns"]:
            self.binner.save(f"{path}/binner")

    @classmethod
    def load(cls, path: str) -> ExtractionModel:
        saved = _Identity.load(path)
        binner = WoeModel.load(f"{path}/binner") if saved.info["columns"] else _Identity()
        return cls(binner, saved.tables["train_woe"], saved.info)

    def transform_train(self, df: DataFrame) -> DataFrame:
        return self.binner.transform(df)

    def _transform(self, df: DataFrame) -> DataFrame:
        info = self.info
        out = [f"{c}_woe" for c in info["columns"]]
        if not out:
            return df
        return hot_deck_fill(self.train_woe, self.binner.transform(df), out, info["id_col"], info["seed"])


class ExtractionRecipe(TableEstimator):
    """Variable filter, supervised WOE bins, WOE columns."""

    def __init__(
        self,
        columns: Sequence[str],
        label: str = "label",
        id_col: str = "id",
        iv_limit: float = 0.02,
        missing_limit: float = 0.95,
        identical_limit: float = 0.95,
        seed: int = 0,
        **tree,
    ):
        super().__init__()
        self.columns, self.label, self.id_col, self.seed = list(columns), label, id_col, seed
        self.limits = {"iv_limit": iv_limit, "missing_limit": missing_limit, "identical_limit": identical_limit}
        self.tree = tree

    def _fit(self, train: DataFrame) -> ExtractionModel:
        checked = var_filter(train, self.columns, self.label, **self.limits)
        passed = {r["VARNAME"] for r in checked.filter("keep").collect()}
        columns = [c for c in self.columns if c in passed]
        info = {"columns": columns, "id_col": self.id_col, "seed": self.seed}
        if not columns:
            return ExtractionModel(_Identity(), train, info)
        binner = TreeWoeBinner(columns, self.label, **self.tree).fit(train)
        return ExtractionModel(binner, binner.transform(train), info)


class _Identity(TableModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df


def numeric_features(df: DataFrame, skip: Sequence[str]) -> list[str]:
    """Columns a learner can use."""
    return [
        f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, T.NumericType)
    ]
