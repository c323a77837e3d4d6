"""The registered queries of this subpackage and the SQL twins of those that SQL can express."""

from __future__ import annotations

from textloom.llm import bpe, debruijn, filter_audit, hilbert, html_tree, line_dedup, ngram_join, packing, pii, spelling, topk, toxicity, wumanber


def queries() -> dict:
    return {
        "op1_semi_markov_pii": pii.query,
        "op2_uniform_threshold": topk.query,
        "op3_debruijn_dedup": debruijn.query,
        "op4_shifted_hilbert": hilbert.query,
        "op5_line_set_join": line_dedup.query,
        "op6_bpe_transducer": bpe.query,
        "op7_token_group_matrix": ngram_join.query,
        "op8_concat_and_cut": packing.query,
        "op9_tree_html": html_tree.query,
        "op10_pattern_grammar": toxicity.query,
        "op11_parity_bands": spelling.query,
        "op12_wu_manber": wumanber.query,
        "op13_sorted_audit": filter_audit.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_uniform_threshold": topk.SQL, "op3_debruijn_dedup": debruijn.SQL, "op5_line_set_join": line_dedup.SQL, "op7_token_group_matrix": ngram_join.SQL, "op11_parity_bands": spelling.SQL, "op12_wu_manber": wumanber.SQL, "op13_sorted_audit": filter_audit.SQL}
