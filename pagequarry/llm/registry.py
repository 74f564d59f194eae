"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from pagequarry.llm import ann, bpe, mixing, passages, quality_mil, quality_rules, secrets, simhash, token_files, warc

QUERIES = {
    "op1_passages": passages.op1_passages,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_warc": warc.op3_warc,
    "op4_neighbours": ann.op4_neighbours,
    "op5_simhash": simhash.op5_simhash,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_secrets": secrets.op7_secrets,
    "op8_quality_mil": quality_mil.op8_quality_mil,
    "op9_token_files": token_files.op9_token_files,
    "op10_mixing": mixing.op10_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op10_mixing": mixing.OP10_SQL,
}
