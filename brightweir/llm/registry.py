"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from brightweir.llm import bpe, collocations, decontaminate, filter_audit, language_id, mixing, quality, secrets, simhash, suffix_dedup, token_store, toxicity, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1,
    "op2_mixing": mixing.op2,
    "op3_quality": quality.op3,
    "op4_secrets": secrets.op4,
    "op5_language_id": language_id.op5,
    "op6_decontaminate": decontaminate.op6,
    "op7_warc": warc.op7,
    "op8_simhash": simhash.op8,
    "op9_token_store": token_store.op9,
    "op10_toxicity": toxicity.op10,
    "op11_filter_audit": filter_audit.op11,
    "op12_bpe": bpe.op12,
    "op13_collocations": collocations.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op7_warc": warc.OP7_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
