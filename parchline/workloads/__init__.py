"""Queries over the driver's tables, each with the SQL it is checked against."""

from . import series, layers, fields, files, forecasts, streams  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
