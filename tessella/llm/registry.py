"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tessella.llm import chat_format, flac, line_dedup, lm_mix, ngram_join, phrase_index, pieces, quality_classifier, quality_rules, secret_scan, source_mix, tandem_runs, token_align

QUERIES = {
    "op1_lm_score": lm_mix.op1_lm_score,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_source_mix": source_mix.op3_source_mix,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_flac": flac.op5_flac,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_pieces": pieces.op9_pieces,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_decontaminate": phrase_index.op11_decontaminate,
    "op12_token_align": token_align.op12_token_align,
    "op13_tandem_runs": tandem_runs.op13_tandem_runs,
}

ORACLES = {
    "op2_chat_format": chat_format.OP2_SQL,
    "op3_source_mix": source_mix.OP3_SQL,
    "op4_secret_scan": secret_scan.OP4_SQL,
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op7_ngram_join": ngram_join.OP7_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_decontaminate": phrase_index.OP11_SQL,
    "op13_tandem_runs": tandem_runs.OP13_SQL,
}
