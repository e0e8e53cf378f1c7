"""Every query of the library over the driver's tables, with its SQL."""

from __future__ import annotations

from partloom.plans import evidence, files, graphs, hierarchy, proposing, reports, requests, review, rules, scalars, searches, sessions, sheets  # noqa: F401  they register their queries
from partloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
