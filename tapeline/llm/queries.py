"""The registered queries of this subpackage and their DuckDB SQL."""

from tapeline.llm import query_compaction, query_decontaminate, query_dedup, query_divergence, query_pages, query_text, query_tokens

QUERIES = {
    "op1_token_output": query_tokens.op1_token_output,
    "op2_ngram_join": query_dedup.op2_ngram_join,
    "op3_language": query_text.op3_language,
    "op4_fingerprint": query_text.op4_fingerprint,
    "op5_warc": query_pages.op5_warc,
    "op6_url_filter": query_pages.op6_url_filter,
    "op7_html_text": query_pages.op7_html_text,
    "op8_best_fit_packing": query_tokens.op8_best_fit_packing,
    "op9_suffix_dedup": query_dedup.op9_suffix_dedup,
    "op10_decontaminate": query_decontaminate.op10_decontaminate,
    "op11_simhash": query_dedup.op11_simhash,
    "op12_compaction": query_compaction.op12_compaction,
    "op13_source_divergence": query_divergence.op13_source_divergence,
}
SQL = {
    "op5_warc": query_pages.WARC_SQL,
    "op6_url_filter": query_pages.URL_SQL,
    "op10_decontaminate": query_decontaminate.SQL,
    "op13_source_divergence": query_divergence.SQL,
}
