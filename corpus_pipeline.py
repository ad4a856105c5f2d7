"""The training-data pipeline over ``documents``: see langloom.llm.stages."""

from langloom.llm.stages import STAGES, run

#: A trained classifier and 64-bit hashes of shingles are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
