"""All registered queries."""

from lexlake.plans import access, edits, more, retrieval, runs, text, usage, versions  # noqa: F401
from lexlake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
