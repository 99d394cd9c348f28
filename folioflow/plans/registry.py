"""All registered queries of the library, with their SQL where SQL can express them."""

from __future__ import annotations

from . import search_plans, service_plans, store_plans, table_plans, text_plans, transcript_plans  # noqa: F401  each registers its queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
