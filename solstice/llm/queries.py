"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import (
    decontamination,
    embedding_dedup,
    filter_audit,
    html_extract,
    jaccard_join,
    language_id,
    line_dedup,
    media_columns,
    mixing,
    sentencepiece_codec,
    spelling_variants,
    suffix_dedup,
    url_filter,
)

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_media_columns": media_columns.op6_media_columns,
    "op7_language_id": language_id.op7_language_id,
    "op8_html_extraction": html_extract.op8_html_extraction,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    "op11_decontamination": decontamination.op11_decontamination,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_spelling_variants": spelling_variants.op13_spelling_variants,
}

ORACLES = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op9_jaccard_join": jaccard_join.OP9_SQL,
    "op10_embedding_dedup": embedding_dedup.OP10_SQL,
    "op11_decontamination": decontamination.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
    "op13_spelling_variants": spelling_variants.OP13_SQL,
}
