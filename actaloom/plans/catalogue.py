"""All queries of the core with their SQL."""

from actaloom.plans import review, stores  # noqa: F401  (they register their queries)
from actaloom.plans.corpus import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
