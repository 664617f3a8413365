"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from loomstone.llm import chat_format, decontamination, license_scan, ngram_join, quality_classifier, quality_rules, repeat_removal, simhash_groups, source_divergence, source_mix, token_counts, warc, window_panes

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_repeat_removal": repeat_removal.op2_repeat_removal,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_source_mix": source_mix.op7_source_mix,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_warc": warc.op9_warc,
    "op11_window_panes": window_panes.op11_window_panes,
    "op12_simhash": simhash_groups.op12_simhash,
    "op13_source_divergence": source_divergence.op13_source_divergence,
}
ORACLES = {"op1_chat_format": chat_format.ORACLE_SQL, "op3_license_scan": license_scan.ORACLE_SQL, "op7_source_mix": source_mix.ORACLE_SQL, "op11_window_panes": window_panes.ORACLE_SQL, "op13_source_divergence": source_divergence.ORACLE_SQL}
