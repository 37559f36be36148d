"""Named queries over the driver tables and their SQL."""

from . import catalog_queries, image_queries, more_queries
from .registry import SQL, queries

__all__ = ["catalog_queries", "image_queries", "more_queries", "oracle_sql", "queries"]


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
