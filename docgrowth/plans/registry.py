"""All queries of the library by name, and their SQL twins."""

from __future__ import annotations

from docgrowth.plans import catalog, documents, growth, layout, plugged, quality, streams
from docgrowth.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "catalog", "documents", "growth", "layout", "plugged", "quality", "streams"]
