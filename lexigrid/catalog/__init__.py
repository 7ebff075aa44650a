"""Registered queries and the SQL they are checked against."""

from lexigrid.catalog import contests, extraction, models, records, scores, texts  # noqa: F401  (they register)
from lexigrid.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
