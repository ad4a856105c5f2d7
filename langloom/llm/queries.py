"""The operators' queries by name, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from langloom.llm import bpe, decontam, hilbert, langid, licenses, quality_net, rules, secrets, simhash, substring
from langloom.llm.oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_byte_bpe": bpe.op1,
    "op2_license_scan": licenses.op2,
    "op3_secret_scan": secrets.op3,
    "op4_quality_network": quality_net.op4,
    "op5_hilbert_shards": hilbert.op5,
    "op6_language_id": langid.op6,
    "op7_substring_dedup": substring.op7,
    "op8_simhash": simhash.op8,
    "op9_decontamination": decontam.op9,
    "op10_quality_rules": rules.op10,
    "base_quality_counters": rules.base_counters,  # what SQL can say of op10_quality_rules
}
