"""The corpus pipeline: its stages, the query over them and its SQL."""

from lumenframe.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
