"""Contracts of the test tables and the queries over them."""


def load():
    """(queries, oracle SQL) of all query modules."""
    from . import check_queries, grid_queries, ref_queries, registry, text_queries
    return registry.QUERIES, registry.SQL
