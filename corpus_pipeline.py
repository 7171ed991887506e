"""The stages of a training corpus, from raw documents to token-id files (`twinsieve.llm.pipeline`)."""

from twinsieve.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
