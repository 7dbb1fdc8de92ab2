"""Registered queries over the star-schema tables and their SQL twins."""

from . import binning, cleaning, coding, filling, learning, scoring
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "binning", "cleaning", "coding", "filling", "learning", "scoring"]
