"""Registered queries and the SQL each is checked with."""

from rarelane.catalog import cleaning, ensembles, evaluation, models, runs, sampling  # noqa: F401
from rarelane.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
