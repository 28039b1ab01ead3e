"""Importing this module registers every engine query."""

from triplewright.plans import adjudication_queries, build_queries, entity_queries, evaluation_queries, graph_queries, lookup_queries, packer_queries, prose_queries, scorer_queries, text_queries, vocabulary_queries  # noqa: F401
from triplewright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
