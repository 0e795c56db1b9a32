"""Queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from quillgate.llm import byte_bpe, chat, exact_dedup, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, resampling, toxicity, warc, whitening

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_chat_format": chat.op2_chat_format,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_warc_transactions": warc.op5_warc_transactions,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_byte_bpe": byte_bpe.op11_byte_bpe,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}
ORACLE_SQL = {
    "op2_chat_format": chat.OP2_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op5_warc_transactions": warc.OP5_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op12_importance_resampling": resampling.OP12_SQL,
}
