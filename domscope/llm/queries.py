"""The queries of this subpackage and the SQL with the same results."""

from __future__ import annotations

from . import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13

QUERIES = {
    "op1_pii": op1.op1_pii,
    "op2_warc_index": op2.op2_warc_index,
    "op3_token_rollup": op3.op3_token_rollup,
    "op4_html_text": op4.op4_html_text,
    "op5_line_dedup": op5.op5_line_dedup,
    "op6_near_copies": op6.op6_near_copies,
    "op7_topk": op7.op7_topk,
    "op8_decontaminate": op8.op8_decontaminate,
    "op9_toxicity": op9.op9_toxicity,
    "op10_byte_bpe": op10.op10_byte_bpe,
    "op11_licenses": op11.op11_licenses,
    "op12_divergence": op12.op12_divergence,
    "op13_merkle": op13.op13_merkle,
}

ORACLE_SQL = {
    "op2_warc_index": op2.ORACLE,
    "op3_token_rollup": op3.ORACLE,
    "op5_line_dedup": op5.ORACLE,
    "op6_near_copies": op6.ORACLE,
    "op7_topk": op7.ORACLE,
    "op8_decontaminate": op8.ORACLE,
    "op12_divergence": op12.ORACLE,
    "op13_merkle": op13.ORACLE,
}
