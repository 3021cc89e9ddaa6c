"""Queries of the training-data operators and the SQL that some of them can be held against."""

from __future__ import annotations

from packlens.llm import decontam, licenses, linededup, lmscore, mixing, neardup, ngramjoin, pii, quality, repeats, secretscan, trie, whiten

QUERIES = {
    "op1_near_duplicates": neardup.op1,
    "op2_secret_scan": secretscan.op2,
    "op3_decontaminate": decontam.op3,
    "op4_personal_data": pii.op4,
    "op5_repeated_bytes": repeats.op5,
    "op6_license_scan": licenses.op6,
    "op7_quality_rules": quality.op7,
    "op8_source_mix": mixing.op8,
    "op9_line_dedup": linededup.op9,
    "op10_lm_scores": lmscore.op10,
    "op11_ngram_join": ngramjoin.op11,
    "op12_prefix_trie": trie.op12,
    "op13_whitening": whiten.op13,
}
ORACLE_SQL = {
    "op1_near_duplicates": neardup.OP1_SQL,
    "op2_secret_scan": secretscan.OP2_SQL,
    "op3_decontaminate": decontam.OP3_SQL,
    "op5_repeated_bytes": repeats.OP5_SQL,
    "op6_license_scan": licenses.OP6_SQL,
    "op7_quality_rules": quality.OP7_SQL,
    "op8_source_mix": mixing.OP8_SQL,
    "op9_line_dedup": linededup.OP9_SQL,
    "op11_ngram_join": ngramjoin.OP11_SQL,
    "op12_prefix_trie": trie.OP12_SQL,
}
