"""The corpus pipeline: stages that each take the documents their predecessor kept."""

from __future__ import annotations

from quillstream.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
