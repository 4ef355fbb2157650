"""Runnable queries over the driver tables."""

from corpusflow.catalog import expressions, jobs, relations, streams  # noqa: F401
from corpusflow.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
