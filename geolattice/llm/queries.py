"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, digest, html_extraction, language_id, line_templates, passages, simhash, token_counts, token_output, word_bpe


def queries() -> dict:
    return {
        "op1_html_extraction": html_extraction.op1_html_extraction,
        "op2_decontamination": decontamination.op2_decontamination,
        "op3_language_id": language_id.op3_language_id,
        "op4_simhash_dedup": simhash.op4_simhash_dedup,
        "op5_token_output": token_output.op5_token_output,
        "op6_bpe_encoding": word_bpe.op6_bpe_encoding,
        "op7_substring_dedup": passages.op7_substring_dedup,
        "op8_fingerprints": digest.op8_fingerprints,
        "op9_line_dedup": line_templates.op9_line_dedup,
        "op10_token_counts": token_counts.op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_fingerprints": digest.OP8_SQL, "op9_line_dedup": line_templates.OP9_SQL}
