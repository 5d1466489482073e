"""Catalogue of queries. Importing the package registers every module."""

from catalog.registry import ORACLE, QUERIES
from catalog import tables, metrics, windows, calibration, walkforward, screens, streams  # noqa: F401,E402

__all__ = ["ORACLE", "QUERIES"]
