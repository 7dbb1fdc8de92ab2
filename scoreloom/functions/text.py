"""Text and list clean-up as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Applied in this order to names whose accents are already gone.
NAME_REPLACEMENTS = {" ": "", "y": "i", ".": "", "-": ""}

# One list element: single-quoted, double-quoted or bare.
_ELEMENT = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^\s,\[\]'"]+"""


def replace_all(column: Column, replacements: Mapping[str, str]) -> Column:
    """Literal replacements applied one after the other, in the mapping's order."""
    for old, new in replacements.items():
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


@cache
def _accent_table() -> tuple[str, str]:
    """Characters whose canonical form is one base plus accents, and those bases.

    Accents standing on their own come last, so ``translate`` removes them.
    """
    source, target, marks = ["đ", "Đ"], ["d", "D"], []
    for code in range(0xC0, 0x2000):
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(char)
            continue
        parts = unicodedata.normalize("NFD", char)
        base = [p for p in parts if unicodedata.category(p) != "Mn"]
        if len(parts) > 1 and len(base) == 1:
            source.append(char)
            target.append(base[0])
    return "".join(source + marks), "".join(target)


def strip_accents(column: Column) -> Column:
    """Base letters only (``đ`` too)."""
    source, target = _accent_table()
    return F.translate(column, source, target)


def normalize_name(column: Column, replacements: Mapping[str, str] | None = None) -> Column:
    """Lower case, accents removed, then blanks, dots, hyphens dropped and ``y`` read as ``i``."""
    return replace_all(strip_accents(F.lower(column)), replacements or NAME_REPLACEMENTS)


def fill_unknown(column: Column, name: str, sentinels: Sequence[str] = ("None",)) -> Column:
    """``unk_<name>`` for NULL and for sentinel texts."""
    known = F.when(~column.isin(list(sentinels)), column)
    return F.coalesce(known, F.lit(f"unk_{name}"))


def parse_list(column: Column) -> Column:
    """Array of strings from a list literal such as ``"['a', 'b']"``; NULL gives an empty array."""
    found = F.regexp_extract_all(F.coalesce(column, F.lit("[]")), F.lit(_ELEMENT), F.lit(0))

    def unquote(item: Column) -> Column:
        body = F.substring(item, F.lit(2), F.length(item) - 2)
        plain = F.regexp_replace(body, r"\\(.)", "$1")
        return F.when(item.rlike("^['\"]"), plain).otherwise(item)

    return F.transform(found, unquote)


def element_count(array: Column, element) -> Column:
    """How often ``element`` occurs in the array."""
    return F.size(F.filter(array, lambda item: item == F.lit(element)))


