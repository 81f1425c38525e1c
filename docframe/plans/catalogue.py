"""All registered queries of the document engine and their SQL twins."""

from __future__ import annotations

from docframe.plans import catalogue_changes, catalogue_functions, catalogue_relations, catalogue_rows  # noqa: F401
from docframe.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
