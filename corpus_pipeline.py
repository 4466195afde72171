"""The corpus pipeline: each stage is written as Parquet to the shared folder and read again as the next one's documents."""

from __future__ import annotations

from halocline.llm.stages import STAGES, run

#: SQL can't express the fitted model nor the tokenizer; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
