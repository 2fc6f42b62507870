"""The registered queries of this subpackage and the SQL that expresses them."""

from __future__ import annotations

from . import bpe, decontaminate, html_text, line_dedup, quality, sharding, simhash, substring_dedup, token_counts, token_file

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_sharding": sharding.op2_sharding,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_html_text": html_text.op5_html_text,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_token_file": token_file.op7_token_file,
    "op8_bpe_roundtrip": bpe.op8_bpe_roundtrip,
    "op9_simhash": simhash.op9_simhash,
    "op10_quality": quality.op10_quality,
}

#: The others can't be expressed in SQL; tests hold them against brute force.
SQL = {"op1_substring_dedup": substring_dedup.OP1_SQL, "op3_line_dedup": line_dedup.OP3_SQL}
