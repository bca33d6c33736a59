"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from barloom.llm import (
    exact_dedup,
    hard_negatives,
    html_extraction,
    maxscore,
    minhash_forest,
    mixing,
    packing,
    pii,
    quality_cnn,
    quality_rules,
    simhash,
    suffix_dedup,
    token_file,
)

QUERIES = {
    "op1_quality_cnn": quality_cnn.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_packing": packing.query,
    "op5_simhash": simhash.query,
    "op6_token_file": token_file.query,
    "op7_quality_rules": quality_rules.query,
    "op8_html_extraction": html_extraction.query,
    "op9_mixing": mixing.query,
    "op10_pii": pii.query,
    "op11_maxscore": maxscore.query,
    "op12_minhash_forest": minhash_forest.query,
    "op13_hard_negatives": hard_negatives.query,
}

#: Where SQL can express the operator; the others are tested against brute force.
SQL = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op9_mixing": mixing.SQL,
    "op11_maxscore": maxscore.SQL,
    "op12_minhash_forest": minhash_forest.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
