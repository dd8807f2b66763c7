"""Every query of the library, and the SQL that says the same."""

from __future__ import annotations

from loam.plans import analytics, answers, crawl, evaluate, ingest, retrieval, texts, turns  # noqa: F401  (registers its queries)
from loam.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
