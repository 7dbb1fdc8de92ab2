"""Missing values as Column expressions: predicate, clean-up, indicators, counts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that stand for a missing cell.
RATE_PATTERNS = ["None", "na", "Nan", "NaN"]
# Everything an ingested frame treats as missing.
INGEST_PATTERNS = ["Nan", "na", "None", "NaN", "[]", -1]


def quoted(name: str) -> str:
    """Column name for use in a SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def _literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(value)


def _pattern_sql(name: str, patterns: Iterable, dtype: T.DataType) -> str:
    """Expression text: the value is one of the patterns that fit the column's type."""
    if isinstance(dtype, T.StringType):
        usable = [p for p in patterns if isinstance(p, str)]
    elif isinstance(dtype, T.NumericType):
        usable = [p for p in patterns if isinstance(p, (int, float)) and not isinstance(p, bool)]
    else:
        usable = []
    if not usable:
        return "false"
    return f"coalesce({quoted(name)} IN ({', '.join(map(_literal, usable))}), false)"


def _missing_sql(name: str, patterns: Iterable, dtype: T.DataType) -> str:
    parts = [f"{quoted(name)} IS NULL", _pattern_sql(name, patterns, dtype)]
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        parts.append(f"isnan({quoted(name)})")
    return "(" + " OR ".join(p for p in parts if p != "false") + ")"


def is_pattern(df: DataFrame, name: str, patterns: Iterable) -> Column:
    """True when the value is one of the patterns."""
    return F.expr(_pattern_sql(name, patterns, df.schema[name].dataType))


def is_missing(df: DataFrame, name: str, patterns: Iterable = RATE_PATTERNS) -> Column:
    """NULL, NaN or a pattern of the column's own type."""
    return F.expr(_missing_sql(name, patterns, df.schema[name].dataType))


def replace_values(df: DataFrame, name: str, patterns: Sequence, value) -> Column:
    """The column with every listed value (``None`` means NULL or NaN) replaced by ``value``."""
    hit = is_pattern(df, name, [p for p in patterns if p is not None])
    if any(p is None for p in patterns):
        hit = hit | is_missing(df, name, [])
    return F.when(hit, F.lit(value)).otherwise(F.col(quoted(name)))


def null_out(df: DataFrame, patterns: Sequence = INGEST_PATTERNS, skip: Sequence[str] = ()) -> DataFrame:
    """Turn NaN and sentinel values of every column into NULL; the ingestion step."""
    clean = {
        f.name: F.expr(
            f"CASE WHEN NOT {_missing_sql(f.name, patterns, f.dataType)} THEN {quoted(f.name)} END"
        )
        for f in df.schema.fields
        if f.name not in skip
    }
    return df.withColumns(clean)


def indicators(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """``<col>_ismiss`` = 1 when the cell is NULL, else 0."""
    return {f"{c}_ismiss": F.expr(f"int({quoted(c)} IS NULL)") for c in columns}


def missing_count(columns: Sequence[str]) -> Column:
    """Number of NULL cells in the row."""
    return F.expr(" + ".join(f"int({quoted(c)} IS NULL)" for c in columns) or "0")


def keep_listed(column: Column, allowed: Sequence) -> Column:
    """The value when it is allowed, else NULL."""
    return F.when(column.isin(list(allowed)), column)


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill NULLs of each column with its constant."""
    return df.na.fill(dict(values))
