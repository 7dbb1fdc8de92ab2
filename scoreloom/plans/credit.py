"""Cleaning specification of the credit-default competition table."""

from __future__ import annotations

from ..functions.values import WORDED_COUNTS
from .recipe import CleaningSpec


# Which numbered columns get which treatment.
PLACES = ["province", "district", "maCv"]
UNKNOWN = [
    "8", "9", "10", "13", "17", "18", "19", "20", "23", "24", "25", "26", "27", "28", "29", "30", "31", "35", "36", "37", "38", "39",
    "41", "42", "43", "44",
]
MEAN_ENCODED = [
    "province", "district", "maCv", "8", "9", "10", "13", "17", "18", "19", "20", "23", "24", "25", "26", "27", "28", "29", "30", "31",
    "36", "37", "38", "39", "41", "42", "43", "44", "45", "47", "48", "49",
]
NUMBERS = ["11", "45", "54", "55", "56", "57"]


def credit_spec() -> CleaningSpec:
    return CleaningSpec(
        rename_prefix="FIELD_",
        rename_count=57,
        names=PLACES,
        unknown=UNKNOWN,
        lower=["10"],
        known_only=["13", "39"],
        lists=["7"],
        composites={"district": ["province", "district"]},
        ordinals={"35": {**WORDED_COUNTS}},
        mean_encoded=MEAN_ENCODED,
        whitelists={"12": [0, 1], "40": [1, 2, 3, 4, 6]},
        numbers=NUMBERS,
        coalesced={"age": ["age_source1", "age_source2"]},
    )
