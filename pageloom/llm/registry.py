"""The queries of this subpackage and their SQL."""

from . import ann, decontaminate, html_text, lang_id, lm_score, mixing, near_dup, token_count, token_file, url_filter

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_token_count": token_count.op2_token_count,
    "op3_token_file": token_file.op3_token_file,
    "op4_lm_score": lm_score.op4_lm_score,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_near_duplicates": near_dup.op7_near_duplicates,
    "op8_language_id": lang_id.op8_language_id,
    "op9_main_text": html_text.op9_main_text,
    "op10_nearest": ann.op10_nearest,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op5_url_filter": url_filter.SQL,
    "op6_mix_sources": mixing.SQL,
}
