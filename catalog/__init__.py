"""Runnable queries and the SQL that checks them."""


def load_catalog() -> None:
    """Import the modules that register queries."""
    from catalog import factor_queries, panel_queries, research_queries, selection_queries, testing_queries  # noqa: F401
