"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from quillstream.plans import analysis_queries, digest_queries, focus_queries, join_queries, ledger_queries, name_queries, nested_queries, pattern_queries, practice_queries, product_queries, reader_queries, rule_queries, section_queries, stream_queries, text_queries, validation_queries, window_queries  # noqa: F401
from quillstream.plans.registry import ORACLE, QUERIES

FLAGSHIP = "top_stories_per_day"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
