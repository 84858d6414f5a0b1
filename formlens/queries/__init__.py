"""All registered queries."""

from formlens.queries import text_queries, vector_queries  # noqa: F401  (fills the registries)
from formlens.queries.text_queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
