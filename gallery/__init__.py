"""Registered queries over the given tables, each next to the SQL it must equal."""

from . import decision, decoding, demand, orders_and_audit, search_and_lookup, state, streams  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
