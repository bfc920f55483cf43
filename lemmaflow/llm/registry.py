"""Queries of this subpackage by name, and SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from . import decontaminate, language_id, line_dedup, odd_sketch, personal_data, quality, secret_scan, simhash, sort_means, source_mix, suffix_dedup, token_align, warc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_source_mix": source_mix.op2_source_mix,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_secrets": secret_scan.op4_secrets,
    "op5_personal_data": personal_data.op5_personal_data,
    "op6_simhash": simhash.op6_simhash,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_quality": quality.op8_quality,
    "op9_warc": warc.op9_warc,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_token_alignment": token_align.op11_token_alignment,
    "op12_odd_sketch": odd_sketch.op12_odd_sketch,
    "op13_sort_means": sort_means.op13_sort_means,
}

ORACLES: dict[str, str] = {
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op12_odd_sketch": odd_sketch.OP12_SQL,
    "op13_sort_means": sort_means.OP13_SQL,
}
