"""Queries over whole tables, each with the SQL that says what it returns where SQL can."""

from lectern.plans import bank_queries, curriculum_queries, draft_queries, item_queries, layout_queries, mining_queries, quality_queries, search_queries, source_queries, text_queries
from lectern.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "bank_queries", "curriculum_queries", "draft_queries", "item_queries", "layout_queries", "mining_queries", "quality_queries", "search_queries", "source_queries", "text_queries"]
