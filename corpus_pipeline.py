"""The corpus pipeline of five operators, as lodestone.llm.pipeline defines it."""

from __future__ import annotations

from lodestone.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
