"""All queries of the library, by name."""

from lodestone.plans import evidence, indexes, relational  # noqa: F401  they register their queries
from lodestone.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
