"""Registered queries of the document operators, and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, elkan, hamming, jaccard, language, mixing, secrets, substrings, suffix_tree, urls, warc, whitening

_QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_language_id": language.op2_language_id,
    "op3_url_filter": urls.op3_url_filter,
    "op3_url_parts": urls.op3_url_parts,
    "op4_topk_search": hamming.op4_topk_search,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_warc_derivatives": warc.op6_warc_derivatives,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op7_base_counts": secrets.op7_base_counts,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op8_mix_copies": mixing.op8_mix_copies,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_suffix_tree_score": suffix_tree.op11_suffix_tree_score,
    "op12_elkan_clusters": elkan.op12_elkan_clusters,
    "op13_tsqr_whitening": whitening.op13_tsqr_whitening,
}
_SQL = {"op4_topk_search": hamming.OP4_SQL, "op1_chat_format": chat.OP1_SQL, "op5_substring_dedup": substrings.OP5_SQL, "op8_mix_sources": mixing.OP8_SQL, "op10_decontaminate": decontaminate.OP10_SQL, "op12_elkan_clusters": elkan.OP12_SQL, "op9_jaccard_join": jaccard.OP9_SQL, "op8_mix_copies": mixing.OP8_COPIES_SQL, "op3_url_parts": urls.OP3_PARTS_SQL, "op7_base_counts": secrets.OP7_COUNTS_SQL}


def queries() -> dict:
    import corpus_pipeline

    return _QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
