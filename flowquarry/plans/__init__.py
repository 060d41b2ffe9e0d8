"""Every registered query, by family."""

from flowquarry.plans.registry import ORACLE, QUERIES
from flowquarry.plans import balancing, cleaning, explaining, learning, positional, profiling, relations, scalars, streams  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
