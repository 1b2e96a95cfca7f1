"""Plans: the analyses bound to the test data, with their oracle SQL."""

from trailmark.plans.registry import REGISTRY, oracle_sql, queries

__all__ = ["REGISTRY", "oracle_sql", "queries"]
