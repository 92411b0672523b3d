"""Queries over the driver's tables, by name, with the SQL they are held against."""

from planloom.plans import (  # noqa: F401  importing a module registers its queries
    graph_queries,
    graph_search_queries,
    harness_queries,
    ordered_queries,
    outcome_queries,
    relational_queries,
    replay_queries,
    report_queries,
    retrieval_queries,
    source_queries,
    text_queries,
)
from planloom.plans.register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
