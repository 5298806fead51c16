"""All queries of the engine, by name."""

from wayring.plans import derived, geometry, groups, history, scoring, streaming, templates, temporal, workspace  # noqa: F401
from wayring.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
