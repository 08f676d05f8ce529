"""Registered queries over the given tables, each with its SQL twin."""


def all_queries():
    """Import every query module and return the registry."""
    from revloom.catalog import (  # noqa: F401
        branch_queries, commit_queries, file_queries, function_queries, history_queries, listing_queries,
        source_queries)
    from revloom.catalog.registry import QUERIES
    return dict(QUERIES)
