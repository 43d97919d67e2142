"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from . import exact_dedup, html_extract, importance, line_dedup, mixing, near_dedup, packing, paragraph_dedup, quality, sharding, token_files, turn_repair, warc

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_paragraph_dedup": paragraph_dedup.op3_paragraph_dedup,
    "op4_html_extraction": html_extract.op4_html_extraction,
    "op5_token_files": token_files.op5_token_files,
    "op6_merkle_fixity": warc.op6_merkle_fixity,
    "op7_mixing": mixing.op7_mixing,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_near_duplicates": near_dedup.op10_near_duplicates,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_byte_shards": sharding.op12_byte_shards,
    "op13_turn_repair": turn_repair.op13_turn_repair,
}
ORACLES = {
    "op9_line_dedup": line_dedup.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_importance_resampling": importance.ORACLE,
    "op12_byte_shards": sharding.ORACLE,
    "op13_turn_repair": turn_repair.ORACLE,
}
