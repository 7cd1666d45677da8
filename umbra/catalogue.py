"""All registered queries and their DuckDB counterparts."""

from umbra.queries import addresses, names, reports, rules, structure  # noqa: F401
from umbra.queries.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
