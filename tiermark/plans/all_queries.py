"""All registered queries: importing this module registers them."""

from tiermark.plans import choice_queries, compare_queries, coverage_queries, function_queries, grid_queries, matching_queries, product_queries, resolve_queries, source_queries, terms_queries, year_queries  # noqa: F401
from tiermark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
