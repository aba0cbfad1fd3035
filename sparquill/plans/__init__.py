"""The library's own queries with their SQL equivalents."""

from sparquill.plans import analytics, corpus, costing, evaluation, events, search, sources, warehouse  # noqa: F401
from sparquill.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
