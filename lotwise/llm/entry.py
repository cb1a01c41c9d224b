"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from lotwise.llm import cascade, decontaminate, licences, maxscore, mixing, neighbours, ngram, packing, prefixtrie, repeats, secretscan, simhash, spelling

QUERIES = {
    "op1_simhash_bktree": simhash.op1_simhash_bktree,
    "op2_kneser_ney": ngram.op2_kneser_ney,
    "op3_bestfit_packing": packing.op3_bestfit_packing,
    "op10_secret_structure": secretscan.op10_secret_structure,
    "op8_neighbour_quality": neighbours.op8_neighbour_quality,
    "op4_maxscore": maxscore.op4_maxscore,
    "op5_hierarchical_mix": mixing.op5_hierarchical_mix,
    "op6_simhash_windows": decontaminate.op6_simhash_windows,
    "op9_licence_tfidf": licences.op9_licence_tfidf,
    "op7_repeat_intervals": repeats.op7_repeat_intervals,
    "op13_prefix_trie": prefixtrie.op13_prefix_trie,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_rule_cascade": cascade.op12_rule_cascade,
}
SQL = {"op4_maxscore": maxscore.OP4_SQL, "op5_hierarchical_mix": mixing.OP5_SQL, "op12_rule_cascade": cascade.OP12_SQL, "op11_spelling_variants": spelling.OP11_SQL, "op13_prefix_trie": prefixtrie.OP13_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
