"""Registered queries: each runs an operator over whole tables, with the same result stated in SQL where that is possible."""

from firmatlas.plans.catalog import collecting, company, lifecycle, results, sites, streams, tables, web  # noqa: F401
from firmatlas.plans.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
