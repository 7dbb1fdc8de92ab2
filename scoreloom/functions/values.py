"""Value maps, bucketings, composite columns and type groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ordinal codes of worded counts and of roman grades.
WORDED_COUNTS = {"Zero": 0, "One": 1, "Two": 2, "Three": 3, "Four": 4}
ROMAN_GRADES = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5}
# Fixed values of the tenure rule: days per year, shift, tolerance, years tried, top class, other.
YEAR_DAYS, SHIFT_DAYS, TOLERANCE_DAYS, YEARS, TOP_YEAR, NO_YEAR = 365.25, 13, 30, 22, 12, -999


def map_values(column: Column, mapping: Mapping, default=None) -> Column:
    """Look the value up in a small mapping; anything else becomes ``default``."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), F.lit(default))


def tenure_year(days: Column) -> Column:
    """Year class of a day count: 0 for 0 and -1, else the first year whose window holds it."""
    result = F.when(days.isin(0, -1), F.lit(0))
    for year in range(1, YEARS + 1):
        middle = int(YEAR_DAYS * year) - SHIFT_DAYS
        result = result.when(
            days.between(middle - TOLERANCE_DAYS, middle + TOLERANCE_DAYS),
            F.lit(min(TOP_YEAR, year)),
        )
    return result.when(days.isNotNull(), F.lit(NO_YEAR))


def composite(parts: Sequence[Column], separator: str = " - ") -> Column:
    """Parts joined with a separator; NULL when any part is NULL."""
    pieces = [parts[0]]
    for part in parts[1:]:
        pieces += [F.lit(separator), part]
    return F.concat(*pieces)


def type_groups(df: DataFrame) -> dict[str, list[str]]:
    """Column names by kind: ``category``, ``numerical``, ``boolean``."""
    groups: dict[str, list[str]] = {"category": [], "numerical": [], "boolean": []}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            groups["category"].append(field.name)
        elif isinstance(field.dataType, T.NumericType):
            groups["numerical"].append(field.name)
        elif isinstance(field.dataType, T.BooleanType):
            groups["boolean"].append(field.name)
    return groups


def cast_numeric(df: DataFrame, to: str = "double", skip: Sequence[str] = ()) -> DataFrame:
    """Cast every numeric and boolean column to one floating type."""
    groups = type_groups(df)
    names = [c for c in groups["numerical"] + groups["boolean"] if c not in skip]
    return df.withColumns({c: F.col(f"`{c}`").cast(to) for c in names})


def number_columns(df: DataFrame, prefix: str = "FIELD_", count: int = 57) -> DataFrame:
    """Rename ``<prefix>1`` .. ``<prefix>n`` to ``1`` .. ``n``."""
    return df.withColumnsRenamed({f"{prefix}{i}": str(i) for i in range(1, count + 1)})
