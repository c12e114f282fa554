"""Registered queries. Importing this package registers all of them."""

from docengine.plans import answer_queries, relational_queries, retrieval_queries, text_queries, understanding_queries, upkeep_queries, web_queries  # noqa: F401
from docengine.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
