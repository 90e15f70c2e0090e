"""The corpus pipeline: toxicity, near-dedup, suffix-array dedup, decontamination, packing."""

from quarry.llm.pipeline import STAGES, run

#: The scorer and the packer can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
